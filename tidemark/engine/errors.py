"""What can go wrong with a statement."""


class SqlError(Exception):
    """Any error of a statement."""


class ParseError(SqlError):
    """The text is no statement of the dialect."""


class Unsupported(ParseError):
    """The text is SQL that the dialect leaves out."""


class AnalysisError(SqlError):
    """A name or type does not fit."""


class ConstraintError(SqlError):
    """A write breaks a constraint."""


class ConflictError(SqlError):
    """Another transaction committed first."""


class ExecutionError(SqlError):
    """A value stops the statement, such as a division by zero."""
