"""What the engine refuses, each with its own type."""


class TidemarkError(Exception):
    """Base of all errors here."""


class SchemaError(TidemarkError, ValueError):
    """A schema rule is broken: names, widths, or the one time column."""


class BatchError(TidemarkError, ValueError):
    """Rows do not fit their table's schema."""


class UnknownColumnError(TidemarkError, KeyError):
    """A predicate or projection names a column that is not there."""


class UnknownSegmentError(TidemarkError, ValueError):
    """Compaction names segments that the manifest does not have."""


class LogError(TidemarkError, ValueError):
    """The append log is damaged or has gaps."""


class ConfigError(TidemarkError, ValueError):
    """A configuration has unknown keys or values out of range."""


class UnsupportedError(TidemarkError):
    """Something that needs devices which Spark does not drive."""


class DoctorError(TidemarkError):
    """Host checks failed; its text says how many."""
