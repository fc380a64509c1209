"""Exceptions raised on the driver, before or while a job is described."""


class QuadweaveError(ValueError):
    """Base of every error this package raises itself."""


class MappingError(QuadweaveError):
    """A mapping is incomplete or uses something that is not supported."""


class IriError(QuadweaveError):
    """A text that has to be an IRI is none."""


class FormatError(QuadweaveError):
    """An RDF format is unknown or cannot be determined."""


class SourceError(QuadweaveError):
    """A source cannot be found, or its reference syntax is not supported."""


class PrefixError(QuadweaveError):
    """Prefix declarations or prefix mapping files are wrong."""
