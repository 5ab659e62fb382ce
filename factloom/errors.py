"""Errors with the codes that callers match on."""


class FactloomError(Exception):
    code = "error"


class QueryValidationError(FactloomError):
    code = "query_validation"


class AnalyticsError(FactloomError):
    code = "analytics_error"


class StaleResultError(FactloomError):
    code = "stale_query_result"


class ImportRejected(FactloomError):
    code = "import_rejected"


class JoinError(FactloomError):
    code = "join_conflict"
