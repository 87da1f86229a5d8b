"""Errors of the facade, each with the numeric code its clients know."""

from __future__ import annotations


class LoomError(Exception):
    """An error with a code and a name; body() is what a client gets."""

    code = 5005
    name = "InvalidParams"

    def __init__(self, message: str = "", **details):
        super().__init__(message or self.name)
        self.details = details

    def body(self) -> dict:
        out = {"code": self.code, "name": self.name, "message": str(self)}
        return out | ({"details": self.details} if self.details else {})


# Error codes by name.
CODES = {
    "WorkspaceNotFound": 1001,
    "NotAGitRoot": 1002,
    "WorkspaceNotSet": 1003,
    "WorkspaceLimitReached": 1005,
    "HydrationFailed": 2001,
    "SchemaMismatch": 2002,
    "StaleWorkspace": 2004,
    "QueryTooLong": 4001,
    "SearchFailed": 4003,
    "QueryEmpty": 4004,
    "QueryRejected": 4010,
    "QueryTimeout": 4011,
    "QueryInvalid": 4012,
    "DatabaseError": 5001,
    "FlushFailed": 5002,
    "RateLimited": 5003,
    "InvalidParams": 5005,
    "ConfigInvalidValue": 6002,
    "IndexInProgress": 7003,
    "SymbolNotFound": 7004,
    "FileTooLarge": 7006,
    "RegistryParseFailed": 10001,
    "RegistryValidationFailed": 10002,
    "IngestionFailed": 11001,
    "GitNotFound": 12001,
    "GitAccessError": 12002,
    "MetricsNotFound": 13002,
    "MetricsParseError": 13003,
    "PolicyDenied": 14001,
}


def error(name: str, message: str = "", **details) -> LoomError:
    """The error of that name, to be raised."""
    e = LoomError(message or name, **details)
    e.code, e.name = CODES[name], name
    return e
