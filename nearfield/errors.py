"""Errors of the engine."""


class VectorError(Exception):
    """Base of all errors here."""


class DimensionMismatch(VectorError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected dimension {expected}, got {actual}")
        self.expected, self.actual = expected, actual


class EmptyIndex(VectorError): ...


class EmptyTrainingSet(VectorError): ...


class InsufficientVectors(VectorError): ...


class InvalidParameter(VectorError, ValueError): ...


class DimensionNotDivisible(InvalidParameter): ...


class NotSupported(VectorError): ...


class SearchTimeout(VectorError): ...


class MemoryLimitExceeded(VectorError): ...


class VectorLimitExceeded(VectorError): ...


class CorruptedData(VectorError): ...


class ChecksumMismatch(CorruptedData): ...


class UnsupportedVersion(CorruptedData): ...


class NotFound(VectorError, KeyError): ...


class AlreadyExists(VectorError): ...


class InvalidConfig(VectorError, ValueError): ...


class IndexNotBuilt(VectorError): ...


class VectorNotFound(NotFound): ...


class StorageError(VectorError, OSError): ...


class SerializationError(VectorError): ...


class MetadataTypeMismatch(VectorError):
    def __init__(self, name: str, expected: str, actual: str):
        super().__init__(f"field {name!r} is {actual}, not {expected}")
        self.name, self.expected, self.actual = name, expected, actual


class MetadataFieldNotFound(NotFound): ...


class ConvergenceFailure(VectorError): ...


class StaleIndex(VectorError): ...


class InsufficientDiskSpace(StorageError):
    def __init__(self, needed: int, free: int):
        super().__init__(f"{needed} bytes needed, {free} free")
        self.needed, self.free = needed, free
