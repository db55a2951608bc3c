"""Errors with the SQLSTATE a client sees."""

from __future__ import annotations


class SqlError(Exception):
    """An error with a five-character SQLSTATE."""

    sqlstate = "XX000"

    def __init__(self, message: str, sqlstate: str | None = None, constraint: str | None = None, retry_after_ms: int | None = None):
        super().__init__(message)
        self.sqlstate = sqlstate or self.sqlstate
        self.constraint, self.retry_after_ms = constraint, retry_after_ms


class Unsupported(SqlError):
    """A statement or shape outside the strict dialect."""

    sqlstate = "0A000"


class UniqueViolation(SqlError):
    sqlstate = "23505"


class NotNullViolation(SqlError):
    sqlstate = "23502"


class ActiveTransaction(SqlError):
    sqlstate = "25001"


class FailedTransaction(SqlError):
    sqlstate = "25P02"


class Retry(SqlError):
    """Serialization failure, write too old or contention; the client may try again."""

    sqlstate = "40001"


class BadText(SqlError):
    sqlstate = "22P02"


class ProtocolViolation(SqlError):
    sqlstate = "08P01"


class UnknownStatement(SqlError):
    sqlstate = "26000"


class UnknownPortal(SqlError):
    sqlstate = "34000"


class UndefinedTable(SqlError):
    sqlstate = "42P01"


class UndefinedColumn(SqlError):
    sqlstate = "42703"


#: SQLSTATE by kind of transaction failure (fixed values of the contract).
TRANSACTION_STATES = {"retry": "40001", "write_too_old": "40001", "contention": "40001", "aborted": "25P02"}
#: How long a client waits before it tries again after contention.
CONTENTION_BACKOFF_MS = 25


def transaction_error(kind: str, message: str) -> SqlError:
    state = TRANSACTION_STATES.get(kind, "XX000")
    kinds = {"40001": Retry, "25P02": FailedTransaction}
    return kinds.get(state, SqlError)(message, retry_after_ms=CONTENTION_BACKOFF_MS if kind == "contention" else None)
