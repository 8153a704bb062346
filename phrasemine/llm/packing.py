"""Arrays as one compressed value of a row."""

from __future__ import annotations

import pickle

import zstandard

from phrasemine.llm.shipping import ship


def pack(**arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 3)


def unpack(payload: bytes) -> dict:
    return pickle.loads(zstandard.decompress(payload))


ship(__name__)
