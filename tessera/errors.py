"""Errors of the query layer and the store."""

from __future__ import annotations


class TesseraError(Exception):
    """Base of all errors here."""


class NotFoundError(TesseraError):
    """A query that needs a row has none."""


class RawArgumentError(TesseraError):
    """A raw fragment has another number of markers than arguments."""


class ProjectionError(TesseraError):
    """A result shape and the columns of a query don't agree."""


class NeedsOrderError(TesseraError):
    """Keyset paging needs an ordering."""


class NeedsLimitError(TesseraError):
    """Paging needs a page size."""


class InvalidPageSizeError(TesseraError):
    """A page size that is not positive."""


class InvalidCursorError(TesseraError):
    """A cursor that can't be read or belongs to another ordering."""


class NullableCursorError(TesseraError):
    """A cursor holds a null for a column whose null placement is not given."""


class UnguardedWriteError(TesseraError):
    """An update or delete of all rows that was not asked for as such."""


class ConstraintError(TesseraError):
    """A commit would break a constraint."""

    def __init__(self, table: str, column: str, detail: str = "") -> None:
        super().__init__(f"{type(self).__name__}: {table}.{column} {detail}".rstrip())
        self.table, self.column = table, column


class UniqueError(ConstraintError):
    pass


class ForeignKeyError(ConstraintError):
    pass


class NotNullError(ConstraintError):
    pass


class CheckError(ConstraintError):
    pass


class SerializationError(TesseraError):
    """Another commit came first; the transaction can be tried again."""


class ConcurrencyError(TesseraError):
    """A versioned row has changed, or a stream has moved on."""


class MissingRowError(TesseraError):
    """An update of a row that is not there."""


class ReadOnlyError(TesseraError):
    """A write in a read-only transaction."""


class BatchPartialError(TesseraError):
    """Some queries of a batch failed; the first failure is the cause."""


class BatchNotExecutedError(TesseraError):
    """A result of a batch that has not run."""


class DuplicateMessageError(TesseraError):
    """A message that its handler has processed."""


class MigrationError(TesseraError):
    pass
