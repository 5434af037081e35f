"""The coding layer of a table of codeblocks: derandomise, then screen for damage.

Damaged blocks are flagged, not repaired.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, IntegerType

from passband.functions.checksum import ragged

# Fixed values of the coding standard.
CODEWORD = 255
FIELD_GENERATOR = 0x187
ROOT_SPACING = 11
FIRST_ROOT = {32: 112, 16: 120}
INTERLEAVE_DEPTHS = (1, 2, 3, 4, 5, 8)
#: Images of the eight conventional basis vectors in the dual basis, top bit first.
DUAL_BASIS = (0x8D, 0xEF, 0xEC, 0x86, 0xFA, 0x99, 0xAF, 0x7B)


@cache
def randomiser() -> np.ndarray:
    """255 octets of the shift register x^8 + x^7 + x^5 + x^3 + 1, all ones to start."""
    bits = [1] * 8
    while len(bits) < CODEWORD * 8:
        bits.append(bits[-8] ^ bits[-5] ^ bits[-3] ^ bits[-1])
    return np.packbits(bits[: CODEWORD * 8])


@cache
def field() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Antilog (doubled), log, and dual-to-conventional tables of GF(256)."""
    antilog = np.zeros(2 * CODEWORD, dtype=np.int64)
    log = np.zeros(256, dtype=np.int64)
    state = 1
    for power in range(CODEWORD):
        antilog[power] = antilog[power + CODEWORD] = state
        log[state] = power
        state <<= 1
        if state & 0x100:
            state ^= FIELD_GENERATOR
    dual = np.zeros(256, dtype=np.int64)
    for bit, image in enumerate(DUAL_BASIS):
        dual ^= np.where(np.arange(256) & (0x80 >> bit), image, 0)
    conventional = np.zeros(256, dtype=np.int64)
    conventional[dual] = np.arange(256)
    return antilog, log, conventional


def derandomise_of(octets: pd.Series) -> list[bytes | None]:
    flat, starts, lengths = ragged(octets)
    position = np.arange(flat.size) - np.repeat(starts, lengths)
    clear = (flat ^ randomiser()[position % CODEWORD]).tobytes()
    return [
        None if b is None else clear[s : s + n] for b, s, n in zip(octets, starts, lengths)
    ]


@pandas_udf(BinaryType())
def derandomise(octets: pd.Series) -> pd.Series:
    """XOR with the sequence, restarting at the first octet of every row."""
    return pd.Series(derandomise_of(octets))


@pandas_udf(BinaryType())
def combine(left: pd.Series, right: pd.Series) -> pd.Series:
    """XOR of two octet columns of equal length, row by row."""
    a, starts, lengths = ragged(left)
    b, _, others = ragged(right)
    if not np.array_equal(lengths, others):
        raise ValueError("octet columns of different lengths cannot be combined")
    mixed = (a ^ b).tobytes()
    return pd.Series([mixed[s : s + n] for s, n in zip(starts, lengths)])


@cache
def _contributions(parity: int) -> np.ndarray:
    """What a dual-basis symbol at each position adds to all syndromes, eight to a word."""
    antilog, log, conventional = field()
    exponent = ROOT_SPACING * (FIRST_ROOT[parity] + np.arange(parity)) % CODEWORD
    place = (exponent[None, :] * np.arange(CODEWORD - 1, -1, -1)[:, None]) % CODEWORD
    symbol = log[conventional]
    each = antilog[symbol[None, :, None] + place[:, None, :]].astype(np.uint8)
    each[:, conventional == 0, :] = 0
    return np.ascontiguousarray(each).view(np.uint64)


def syndrome_weights(codewords: np.ndarray, parity: int) -> np.ndarray:
    """Non-zero syndromes of each row of an (n, 255) array of dual-basis symbols."""
    table = _contributions(parity)
    held = np.zeros((len(codewords), parity // 8), dtype=np.uint64)
    for at in range(CODEWORD):
        held ^= table[at][codewords[:, at]]
    return np.count_nonzero(held.view(np.uint8), axis=1)


def screen(parity: int = 32, interleave: int = 1):
    """A column function: non-zero syndromes over the codewords of a block; 0 is clean.

    Symbol ``i`` of a block belongs to codeword ``i mod interleave``.  Null for a block of the
    wrong length.
    """
    if parity not in FIRST_ROOT:
        raise ValueError(f"parity symbols must be one of {sorted(FIRST_ROOT)}, got {parity}")
    if interleave not in INTERLEAVE_DEPTHS:
        raise ValueError(f"interleaving depth must be one of {INTERLEAVE_DEPTHS}, got {interleave}")
    size = CODEWORD * interleave

    @pandas_udf(IntegerType())
    def weights(octets: pd.Series) -> pd.Series:
        whole = octets.map(lambda b: b is not None and len(b) == size).to_numpy(dtype=bool)
        out = pd.Series([None] * len(octets), dtype="Int32")
        if whole.any():
            flat = np.frombuffer(b"".join(octets[whole]), dtype=np.uint8)
            lanes = flat.reshape(-1, CODEWORD, interleave).transpose(0, 2, 1).reshape(-1, CODEWORD)
            each = syndrome_weights(lanes, parity).reshape(-1, interleave).sum(axis=1)
            out[whole] = each.astype("int32")
        return out

    return weights


def screened(
    blocks: DataFrame, *, block: str = "block", parity: int = 32, interleave: int = 1
) -> DataFrame:
    """Add ``syndromes`` and ``dirty``; a block of the wrong length is dirty."""
    weights = screen(parity, interleave)
    return blocks.withColumn("syndromes", weights(F.col(block))).withColumn(
        "dirty", F.coalesce(F.col("syndromes") > 0, F.lit(True))
    )


def information(block: Column, parity: int, interleave: int) -> Column:
    """The transfer frame in front of the check symbols."""
    return F.substring(block, 1, (CODEWORD - parity) * interleave)
