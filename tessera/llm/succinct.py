"""Compact arrays for memory-mapped levels: bit-packed integers, Elias-Fano sequences, and the file that holds them."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import struct
import tempfile
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyarrow import fs

U = np.uint64
BYTE, TOPS = U(0x0101010101010101), U(0x8080808080808080)
SELECT = np.full((256, 8), 8, np.uint8)
for _b in range(256):
    for _r, _p in enumerate(p for p in range(8) if _b >> p & 1):
        SELECT[_b, _r] = _p


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of so many bits each, one after another in 64-bit words, and one word more."""
    out = np.zeros(len(values) * width // 64 + 2, U)
    if width and len(values):
        at = np.arange(len(values), dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(U)
        v = values.astype(U)
        np.bitwise_or.at(out, word, v << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (U(64) - shift[over]))
    return out


def unpack(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.int64)
    at = i * width
    word, shift = at >> 6, (at & 63).astype(U)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return ((low | high) & U((1 << width) - 1)).astype(np.int64)


def elias_fano(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A monotone sequence: low bits packed, high bits in unary, and the ones before each word of these."""
    n = len(values)
    width = max(0, (universe // max(1, n)).bit_length() - 1)
    place = (values >> width) + np.arange(n)
    words = np.zeros((int(place[-1]) >> 6) + 1 if n else 1, U)
    np.bitwise_or.at(words, place >> 6, U(1) << (place & 63).astype(U))
    before = np.cumsum(np.concatenate(([0], np.bitwise_count(words)[:-1]))).astype(np.int64)
    return {"low": pack(values & ((1 << width) - 1), width), "high": words, "before": before, "width": np.array([width], np.int64)}


def access(ef: dict[str, np.ndarray], i: np.ndarray) -> np.ndarray:
    """The i-th values of an Elias-Fano sequence."""
    before, width = ef["before"], int(ef["width"][0])
    word = np.searchsorted(before, i, "right") - 1
    place = word << 6
    place += select(ef["high"][word], (i - before[word]).astype(U))
    return (place - i << width) | unpack(ef["low"], width, i)


def select(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th one in each 64-bit word: sums of ones by byte side by side, the byte by comparing them with the rank."""
    sums = x - (x >> U(1) & U(0x5555555555555555))
    sums = (sums & U(0x3333333333333333)) + (sums >> U(2) & U(0x3333333333333333))
    sums = (sums + (sums >> U(4)) & U(0x0F0F0F0F0F0F0F0F)) * BYTE
    byte = np.bitwise_count(((rank * BYTE | TOPS) - sums) & TOPS).astype(U) << U(3)
    rest = rank - (sums << U(8) >> byte & U(255))
    return (byte + SELECT[(x >> byte & U(255)).astype(np.int64), rest.astype(np.int64)]).astype(np.int64)


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: the arrays 8-byte aligned, then their names, types, places and lengths, then the length of that."""
    where, inner = fs.FileSystem.from_uri(path)
    table, at = {}, 0
    with where.open_output_stream(inner, compression=None) as out:
        for name, x in arrays.items():
            data = np.ascontiguousarray(x).tobytes()
            table[name] = [x.dtype.str, at, len(x)]
            out.write(data + b"\0" * (-len(data) % 8))
            at += len(data) + -len(data) % 8
        tail = json.dumps(table).encode()
        out.write(tail + struct.pack("<Q", len(tail)))


@lru_cache(maxsize=4096)
def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped; a file of a remote store is copied to the executor's temporary folder first, once for all its workers."""
    where, inner = fs.FileSystem.from_uri(path)
    if not isinstance(where, fs.LocalFileSystem):
        local = Path(tempfile.gettempdir()) / f"tessera-level-{hashlib.sha256(path.encode()).hexdigest()[:24]}"
        if not local.exists():
            with where.open_input_stream(inner, compression=None) as src, tempfile.NamedTemporaryFile(dir=local.parent, delete=False) as dst:
                shutil.copyfileobj(src, dst)
            os.replace(dst.name, local)
        inner = str(local)
    data = np.memmap(inner, np.uint8, "r")
    (length,) = struct.unpack("<Q", data[-8:].tobytes())
    table = json.loads(data[-8 - length : -8].tobytes())
    return {name: np.frombuffer(data, kind, n, at) for name, (kind, at, n) in table.items()}
