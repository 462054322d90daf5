"""Byte-pair vocabularies from rank files, and the pre-token split that goes before their merges.

A rank file is read on the driver and broadcast; each Python worker builds its encoder once.
The split is the usual one of byte-level BPE (contractions, runs of letters, digits or other signs with
the space before them, runs of white space), done here for a whole batch at once.
"""

from __future__ import annotations

import base64
import unicodedata

import numpy as np

from . import textkernel as tk

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The vocabulary file is a parameter of every operator that needs one; this is its default.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_encoders: dict[bytes, object] = {}
_classes: list[np.ndarray] = []
_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(data: bytes):
    """The encoder for a rank file's content, built once in a process."""
    import tiktoken

    if data not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _encoders[data] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[data]


def _class_table() -> np.ndarray:
    if not _classes:
        kinds = {"L": _LETTER, "N": _DIGIT}
        table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _classes.append(table)
    return _classes[0]


def pretokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, start, end, text) of every pre-token, in order."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        z = np.zeros(0, np.int64)
        return code, z, z, z
    off = np.concatenate(([0], np.cumsum(size)))
    kind = _class_table()[code]
    new = np.ones(len(code), np.bool_)
    new[1:] = kind[1:] != kind[:-1]
    new[off[:-1][size > 0]] = True
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(code))
    k = kind[s]
    doc = np.searchsorted(off, s, "right") - 1
    follows = np.append(doc[1:] == doc[:-1], False)  # another run of the same text follows
    space = (k == _SPACE) & follows
    lends = space & (code[e - 1] == 32)  # its last space goes to the next run
    taken = np.append(False, lends[:-1])
    s = s - taken
    # the white space itself: all but its last character, if that is lent or stands alone
    body_end = np.where(space, e - 1, e)
    alone = space & ~lends & (e - s > 1)  # two tokens
    single = space & ~lends & (e - s == 1)
    body_end[single] = e[single]
    # contractions: an apostrophe by itself, then letters
    nxt = np.append(s[1:], len(code))
    quote = (k == _OTHER) & ~taken & (e - s == 1) & (code[s] == 39) & follows & (np.append(k[1:], 9) == _LETTER)
    extra = np.zeros(len(s), np.int64)
    at = np.flatnonzero(quote)
    if len(at):
        a = code[nxt[at]]
        room = e[at + 1] - nxt[at] > 1
        b = np.where(room, code[np.minimum(nxt[at] + 1, len(code) - 1)], 0)
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        extra[at] = np.where(one, 1, np.where(two, 2, 0))
    s2 = s + np.append(0, extra[:-1])
    end = body_end + extra
    starts = np.concatenate((s2, e[alone] - 1))
    ends = np.concatenate((end, e[alone]))
    docs = np.concatenate((doc, doc[alone]))
    real = ends > starts
    starts, ends, docs = starts[real], ends[real], docs[real]
    order = np.argsort(starts, kind="stable")
    return code, starts[order], ends[order], docs[order]


def hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * tk.powers(len(code)), out=total[1:])
    if not len(start):
        return np.zeros(0, np.uint64)
    h = (total[end] - total[start]) * tk.powers(len(code), True)[start]
    return tk.mix(h ^ (end - start).astype(np.uint64))


def string(code: np.ndarray, start: int, end: int) -> str:
    return code[start:end].tobytes().decode("utf-32-le", "surrogatepass")
