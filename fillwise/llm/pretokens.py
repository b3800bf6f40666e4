"""Exact word-wise use of a byte-level BPE tokenizer file: cuts texts as its pattern does, in numpy.

The pattern gives each word its tokens without regard to its neighbours, so a text's ids are the
ids of its words. Most words repeat; a worker encodes each new one once.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from fillwise.llm.common import worker_state

LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3
#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Words a worker remembers; beyond, it forgets all and begins anew.
CACHED_WORDS = 1_000_000
#: Characters cut at a time.
CHUNK_CHARS = 250_000


def load(path: str):
    """The library's tokenizer with truncation and padding off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def cut_by_words(spec: dict) -> bool:
    """Whether a tokenizer file is a plain byte-level BPE, for which cutting into words is exact."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    return (
        spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        and not before.get("add_prefix_space") and model.get("type") == "BPE" and not model.get("dropout")
        and plain and all(t["content"] for t in spec["added_tokens"])
    )


def class_table(tokenizer) -> bytes:
    """The class of each code point. The library decides those that Python's Unicode tables don't know."""
    table = np.full(0x110000, OTHER, np.uint8)
    unknown = []
    for code in (*range(0xD800), *range(0xE000, 0x40000)):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LN":
            table[code] = LETTER if kind[0] == "L" else NUMBER
        elif kind == "Cn":
            unknown.append(code)
    table[WHITE_SPACE] = WHITE
    for first in range(0, len(unknown), 20_000):
        codes = unknown[first : first + 20_000]
        text = "".join(f"a{chr(c)}1{chr(c)}!" for c in codes)
        starts = {a for _, (a, _) in tokenizer.pre_tokenizer.pre_tokenize_str(text)}
        for i, code in enumerate(codes):
            if 5 * i + 1 not in starts:
                table[code] = LETTER
            elif 5 * i + 3 not in starts:
                table[code] = NUMBER
    return table.tobytes()


def cut(segments: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All words of the segments in order, and how many each segment has.

    A word is a run of letters, of digits or of other signs with the blank before it, an English
    contraction ('s 't 'm 'd 're 've 'll) where a run of signs begins with its apostrophe, or white
    space: all but the last of a run that something follows, and that last one unless it is a blank.
    """
    joined = "".join(segments)
    n = len(joined)
    ends = np.cumsum([len(s) for s in segments])
    if not n:
        return [], np.zeros(len(segments), np.int64)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = table[codes]
    edge = np.zeros(n + 1, bool)
    edge[0] = True
    edge[ends] = True
    inner = ~edge[1:n]
    run = edge[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    start = run.copy()
    before_word = white[:-1] & ~white[1:] & inner
    start[:-1] |= before_word
    start[1:] &= ~(before_word & (codes[:-1] == 32))
    at = np.flatnonzero((codes == 39) & start & run)
    at = at[~edge[at + 1]]
    if len(at):
        one = codes[at + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & ~edge[np.minimum(at + 2, n)]
        two = codes[np.minimum(at + 2, n - 1)]
        long &= ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[at[short | long] + 1] = False
        after = np.concatenate([at[short] + 2, at[long] + 3])
        start[after[after < n]] = True
    begin = np.flatnonzero(start)
    per_segment = np.diff(np.searchsorted(begin, ends, "left"), prepend=0)
    first = begin.tolist()
    return [joined[a:b] for a, b in zip(first, first[1:] + [n])], per_segment


def split_special(text: str, special: list[str]) -> list[str]:
    """Turns of ordinary text and special strings (at odd places), the leftmost and then longest first."""
    if not any(s in text for s in special):
        return [text]
    import re

    return re.split("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")", text)


class Encoder:
    """Token ids of texts, exactly as the tokenizer file gives them, from words encoded once.

    `encode_words` maps new words to id lists: the library, or the merge rounds of llm.bpe.
    """

    def __init__(self, path: str, table: bytes, encode_words=None):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = load(path)
        self.by_words = cut_by_words(spec)
        self.special = {t["content"]: np.array([t["id"]], np.uint32).tobytes() for t in spec["added_tokens"]}
        self.table = np.frombuffer(table, np.uint8)
        self.encode_words = encode_words or self._by_library
        self.known: dict[str, bytes] = {}

    def _by_library(self, words: list[str]) -> list[bytes]:
        got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, word = np.array(got.ids, np.uint32), np.array(got.word_ids, np.int64)
        ends = np.searchsorted(word, np.arange(len(words)), "right").tolist()
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids, as little-endian unsigned 32-bit numbers."""
        if not self.by_words:
            return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [split_special(t, list(self.special)) for t in texts]
        words, counts = cut([s for p in parts for s in p[::2]], self.table)
        own = dict.fromkeys(words)  # small, so that most look-ups stay in the processor's cache
        known = self.known
        found = list(map(known.get, own))
        new = [w for w, ids in zip(own, found) if ids is None]
        if new:
            made = dict(zip(new, self.encode_words(new)))
            found = [made[w] if ids is None else ids for w, ids in zip(own, found)]
            if len(known) + len(new) > CACHED_WORDS:
                known.clear()
            known.update(made)
        own = dict(zip(own, found))
        ids = list(map(own.__getitem__, words))
        ends = np.cumsum(counts).tolist()
        out, segment, first = [], 0, 0
        for p in parts:
            turns = []
            for i, s in enumerate(p):
                if i % 2:
                    turns.append(self.special[s])
                else:
                    turns.extend(ids[first : ends[segment]])
                    first = ends[segment]
                    segment += 1
            out.append(b"".join(turns))
        return out


def library_encoder(path: str, table: bytes) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    return worker_state(("library", path), lambda: Encoder(path, table))
