"""All registered queries of the price engine and their SQL oracles."""

from pricewright.operators import activity, fulltext, history, identity, matching, offers, pages, quality, roster, search
from pricewright.plans import compare, hubs, matching_deep
from pricewright.streaming import jobs

MODULES = [offers, history, activity, search, fulltext, matching, identity, roster, pages, quality, compare, matching_deep, hubs, jobs]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: text for module in MODULES for name, text in module.ORACLES.items()}
