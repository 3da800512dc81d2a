"""Byte-level BPE over Arrow batches: each distinct piece of text is encoded once a chunk.

A token never spans the place where a separator follows a non-separator, because in the
pre-tokeniser's pattern white space only opens a match. So texts are cut there, Arrow
dictionary-encodes the pieces (exactly, not by a hash alone), and the distinct pieces are encoded
in one call as one text; token byte lengths tell where each piece's ids end. Pieces for which a
neighbour could matter (texts' first and last pieces, white space outside ASCII) are encoded alone.
"""

from __future__ import annotations

import base64
import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tarmaq.llm.textkit import _IS_SPACE, Texts, pieces_of

#: Text bytes worked on at a time.
TOKEN_CHUNK = 6 << 20
#: White space outside ASCII.
_WIDE_SPACE = re.compile("[\u0085   -     　]")
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


@lru_cache(maxsize=4)
def encoder(path: str, specials: bool = False):
    """(text to ids, byte length of each id or None) of a .tiktoken rank file or a tokenizers .json.

    The special tokens' strings in a text are ordinary text, or with ``specials`` the special tokens, as the tokenizers
    library has it by default.
    """
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        sizes[list(ranks.values())] = [len(x) for x in ranks]
        own = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = special_tokens(path) if specials else {}
        if not added:
            return own.encode_ordinary, sizes
        split = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")
        return lambda text: [i for x in split.split(text) for i in ([added[x]] if x in added else own.encode_ordinary(x))], sizes
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not specials
    return lambda text: t.encode(text, add_special_tokens=False).ids, None


@lru_cache(maxsize=2)
def special_tokens(path: str) -> dict[str, int]:
    """Strings and ids of the added tokens of a tokenizers .json, or of the one beside a rank file."""
    with open(re.sub(r"\.tiktoken$", ".json", path), encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


def default_path() -> str:
    """The rank file of the 50k byte BPE: the same ids as its .json, several times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass
class Encoded:
    """Piece k of the chunk has ids[start[k]:start[k] + length[k]]; document i has pieces first[i]:first[i + 1]."""

    ids: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        """Tokens of each document."""
        total = np.concatenate(([0], np.cumsum(self.length)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def flat(self) -> np.ndarray:
        """All ids of the chunk, document after document."""
        return self.ids[pieces_of(self.start, self.length)]


def _may_hold_wide(data: np.ndarray) -> bool:
    at = np.flatnonzero(_LEADS[data])
    if not len(at):
        return False
    nxt = data[np.minimum(at + 1, len(data) - 1)]
    c2 = data[at] == 0xC2
    return bool((~c2).any() or ((nxt == 0x85) | (nxt == 0xA0))[c2].any())


def encode(t: Texts, path: str, specials: bool = False) -> Encoded:
    """Token ids of each text of a chunk; with ``specials`` those of special tokens where their strings stand."""
    n = len(t.data)
    enc, token_bytes = encoder(path, specials)
    if not n:
        zero = np.empty(0, np.int64)
        return Encoded(np.empty(0, np.uint32), zero, zero, np.zeros(len(t.offsets), np.int64))
    space = _IS_SPACE[t.data]
    cut = np.empty(n, bool)
    np.greater(space[1:], space[:-1], out=cut[1:])
    wide = _may_hold_wide(t.data)
    if wide:
        for i in range(len(t)):
            a, b = t.offsets[i], t.offsets[i + 1]
            if _WIDE_SPACE.search(t.data[a:b].tobytes().decode("utf-8", "replace")):
                cut[a:b] = False
    cut[t.offsets[:-1][t.offsets[:-1] < n]] = True
    at = np.flatnonzero(cut)
    bounds = np.append(at, n).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(t.data))]).dictionary_encode()
    values = pieces.dictionary
    ends = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], np.uint8)
    alone = ~_IS_SPACE[raw[ends[:-1]]] | _IS_SPACE[raw[ends[1:] - 1]]
    if token_bytes is None:
        alone[:] = True
    elif wide:
        alone |= np.fromiter((bool(_WIDE_SPACE.search(x.decode("utf-8"))) for x in values.to_pylist()), bool, len(values))
    if specials and token_bytes is not None:
        for x in special_tokens(path):
            alone |= np.asarray(pc.match_substring(values, x))
    length = np.zeros(len(values), np.int64)
    together = values.filter(pa.array(~alone))
    ids = np.empty(0, np.uint32)
    if len(together):
        own = np.frombuffer(together.buffers()[1], np.int64)[: len(together) + 1]
        ids = np.array(enc(bytes(together.buffers()[2])[: own[-1]].decode("utf-8")), np.uint32)
        upto = np.searchsorted(np.cumsum(token_bytes[ids]), own[1:], "left") + 1
        length[~alone] = np.diff(upto, prepend=0)
    start = np.zeros(len(values), np.int64)
    start[~alone] = np.cumsum(length[~alone]) - length[~alone]
    extra, total = [ids], len(ids)
    for k in np.flatnonzero(alone):
        one = np.array(enc(values[int(k)].as_py().decode("utf-8")), np.uint32)
        start[k], length[k] = total, len(one)
        total += len(one)
        extra.append(one)
    which = np.asarray(pieces.indices)
    return Encoded(np.concatenate(extra), start[which], length[which], np.searchsorted(at, t.offsets).astype(np.int64))
