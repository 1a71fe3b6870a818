"""Record serde: schemas by hash, tagged values, plain and packed records, single-field reads and sizes."""

from .codec import Codec, decode_vector, encode_vector, vector_kind
from .schema import BigInt, Clamped, FieldSpec, Map, Registry, Schema, Set
from .wire import CodecError

__all__ = ["BigInt", "Clamped", "Codec", "CodecError", "FieldSpec", "Map", "Registry", "Schema", "Set", "decode_vector", "encode_vector", "vector_kind"]
