"""Image and page codecs on the standard library and numpy."""


class CodecError(ValueError):
    """Bytes that can't be decoded, or a codec that isn't there."""
