"""Query plans over the tables: importing the package registers all of them."""

from quadrille.plans import books, formulas, registry, rules, sheets, values  # noqa: F401
