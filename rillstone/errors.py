"""Errors raised while a query is planned."""


class RillError(Exception):
    """Base of all errors of this package."""


class ParseError(RillError):
    """The text is not a statement of the dialect."""


class PlanError(RillError):
    """Names or types don't fit."""


class CatalogError(RillError):
    """An object is missing, exists already, or is not supported."""
