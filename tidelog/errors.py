"""What requests can fail with; ``kind`` is the name that clients see."""

from __future__ import annotations


class RequestError(ValueError):
    kind = "error"

    def __init__(self, what: str = ""):
        super().__init__(f"{self.kind}: {what}" if what else self.kind)


def _named(name: str, kind: str) -> type[RequestError]:
    return type(name, (RequestError,), {"kind": kind, "__doc__": f"Raised as {kind}."})


CollectionAlreadyExists = _named("CollectionAlreadyExists", "collection_already_exists")
CollectionNotFound = _named("CollectionNotFound", "collection_not_found")
KeyNotFound = _named("KeyNotFound", "key_not_found")
KeyNotOwnedByShard = _named("KeyNotOwnedByShard", "key_not_owned_by_shard")
MissingField = _named("MissingField", "missing_field")
BadFieldType = _named("BadFieldType", "bad_field_type")
UnsupportedField = _named("UnsupportedField", "unsupported_field")
Timeout = _named("Timeout", "timeout")
VersionConflict = _named("VersionConflict", "version_conflict")
