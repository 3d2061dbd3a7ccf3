"""Errors of the library."""


class BoxloomError(ValueError):
    """Base of all."""


class ManifestError(BoxloomError):
    """A manifest breaks its contract."""


class DatasetBuildError(BoxloomError):
    """A dataset, split or run configuration cannot be built."""


class ParseFormatError(BoxloomError):
    """An answer format is unknown."""
