"""Sealed bytes inside Python workers, which have no AES: HMAC-SHA256 in counter mode, then a tag over all of it.

A sealed value is nonce (16 bytes), text under the key stream, tag (32 bytes). Nothing that was changed, or
sealed with another secret, opens.
"""

from __future__ import annotations

import hashlib
import hmac
import os

_NONCE, _TAG = 16, 32


def _keys(secret: str) -> tuple[bytes, bytes]:
    root = hashlib.sha256(secret.encode()).digest()
    return tuple(hmac.digest(root, use, "sha256") for use in (b"stream", b"tag"))


def _stream(key: bytes, nonce: bytes, data: bytes) -> bytes:
    blocks = b"".join(hmac.digest(key, nonce + i.to_bytes(8, "big"), "sha256") for i in range(-(-len(data) // 32)))
    return (int.from_bytes(data, "big") ^ int.from_bytes(blocks[: len(data)], "big")).to_bytes(len(data), "big")


def seal_bytes(secret: str, data: bytes) -> bytes:
    stream, tag = _keys(secret)
    nonce = os.urandom(_NONCE)
    body = nonce + _stream(stream, nonce, data)
    return body + hmac.digest(tag, body, "sha256")


def open_bytes(secret: str, sealed: bytes) -> bytes:
    """What was sealed; ValueError if it was changed or sealed with another secret."""
    stream, tag = _keys(secret)
    body, told = sealed[:-_TAG], sealed[-_TAG:]
    if len(sealed) < _NONCE + _TAG or not hmac.compare_digest(hmac.digest(tag, body, "sha256"), told):
        raise ValueError("sealed value doesn't open")
    return _stream(stream, body[:_NONCE], body[_NONCE:])
