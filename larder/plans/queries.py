"""All queries of the core, by name."""

from larder.plans.catalogue import QUERIES as CATALOGUE
from larder.plans.corpus import QUERIES as CORPUS

QUERIES = CORPUS | CATALOGUE
