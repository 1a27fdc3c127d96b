"""Vectorised views of a batch of texts as bytes; memory is bounded by ``CHUNK`` whatever a text's length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 20


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def chunks(texts: Iterable[bytes], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of whole texts, and slices of texts longer than ``CHUNK``, as (bytes, starts, owners,
    places in the owner).

    A long text's slices overlap by ``overlap`` bytes, so that every window of ``overlap`` + 1 bytes
    lies in exactly one slice. Empty texts are left out.
    """
    parts: list[bytes] = []
    owners: list[int] = []
    places: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - overlap, min(len(t), 1)), CHUNK):
            piece = t[at : at + CHUNK + overlap]
            if size + len(piece) > CHUNK + overlap and parts:
                yield _joined(parts, owners, places)
                parts, owners, places, size = [], [], [], 0
            parts.append(piece)
            owners.append(i)
            places.append(at)
            size += len(piece)
    if parts:
        yield _joined(parts, owners, places)


def _joined(parts: list[bytes], owners: list[int], places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, np.array(owners, np.int64), np.array(places, np.int64)
