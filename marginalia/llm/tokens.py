"""Token ids by a public tokenizer, memoised by word.

The tokenizer's pattern never joins characters across ASCII blanks and drops
them, so a text's ids are those of its blank-separated words in turn.  Each
worker keeps the ids of words it has met, in two generations of bounded bytes;
words not met yet are encoded together, a batch of documents at a time.  Words
over ``LONGEST`` bytes (text without blanks, encoded data) are never kept.

Most time goes into words not met before, and most of that into the library's
normalizer and patterns, not its BPE.  Words of ASCII, Latin and Cyrillic
letters, ASCII digits and ASCII signs are therefore lower-cased and cut here,
and only their pieces are given to the library's BPE model (see ``Plain``).
All other words go through the whole tokenizer.
"""

from __future__ import annotations

import codecs
import itertools
import json
import os
import re
import sys
import unicodedata
from array import array

import numpy as np

END_ID = 2
#: Bytes of memory that a generation of words takes before the next begins, and of a word and its ids beside their own.
GENERATION, ENTRY = 200 << 20, 150
#: Longest word, in bytes, that is kept.
LONGEST = 64


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The normalizer and pattern that ``Plain`` does itself.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _shaped(tokenizer) -> bool:
    """Whether the tokenizer does nothing before and after its BPE model but what ``Plain`` does."""
    made = json.loads(tokenizer.to_str())
    cuts = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
    return (
        (made["normalizer"] or {}).get("normalizers") == NORMALIZER
        and len(cuts) == 2
        and {k: cuts[0].get(k) for k in ("type", "pattern", "behavior", "invert")} == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
        and {k: cuts[1].get(k) for k in ("type", "add_prefix_space", "use_regex")} == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
        and made["model"]["type"] == "BPE"
        and not made["model"].get("dropout")
        and all(made[k] is None for k in ("post_processor", "truncation", "padding"))
    )


class Plain:
    """Ids of plain words by the BPE model alone.

    A plain word has ASCII letters, digits and signs, and letters from the Latin
    and Cyrillic blocks that are their own NFC form, join with no neighbour and
    lower-case to one such letter; what these are and the bytes' letters of the
    model are asked of the tokenizer's own parts.  Words that hold an added
    token's text are not plain.
    """

    def __init__(self, tokenizer):
        self.model = tokenizer.model
        lower, cut = tokenizer.normalizer.normalize_str, lambda x: [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(x)]
        blocks = map(chr, (*range(0xC0, 0x250), *range(0x400, 0x530)))
        plain, self.bytes = set(), [chr(b) for b in range(256)]  # the model's letter for each byte
        for c in blocks:
            low = lower(c)
            if len(low) == 1 and low == c.lower() and not unicodedata.combining(c) and all(unicodedata.is_normalized("NFC", x) for x in (c, low)) and all(len(cut(f"a{x}{x}a")) == 1 for x in (c, low)):
                for x in (c, low):
                    plain.add(x)
                    for b, letter in zip(x.encode(), cut(x)[0]):
                        self.bytes[b] = letter
        self.bytes, self.letters = "".join(self.bytes), "".join(sorted(plain))
        self.words = re.compile(rf"^[!-~{self.letters}]*$", re.MULTILINE).findall
        # cut when the bytes have their letters: none but those of a plain letter lies beyond ASCII
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\uffff]+|[0-9]|[^0-9a-z\x80-\uffff]+").findall
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added), re.IGNORECASE).search if added else lambda text: None

    def encode(self, words: list[bytes]) -> tuple[list[bytes], list[bytes], list[bytes]]:
        """The plain ones of ``words``, their ids, and the other ones."""
        text = b"\n".join(words).decode("utf-8", "replace")
        found, rest = self.words(text), []
        if len(found) < len(words) or self.added(text):
            known, added = set(found), self.added
            of = {w: x in known and not added(x) for w, x in zip(words, text.split("\n"))}
            words, rest = [w for w in words if of[w]], [w for w in words if not of[w]]
            text = b"\n".join(words).decode()
        model, pieces, met, flat, ends = self.model.tokenize, self.pieces, {}, array("H"), [0]
        for word in codecs.charmap_decode(text.lower().encode(), "strict", self.bytes)[0].split("\n") if words else []:
            for p in (word,) if word.isascii() and word.isalpha() else pieces(word):
                ids = met.get(p)
                if ids is None:
                    ids = met[p] = array("H", [t.id for t in model(p)])
                flat += ids
            ends.append(2 * len(flat))
        data = flat.tobytes()
        return words, [data[a:b] for a, b in itertools.pairwise(ends)], rest


class Encoder:
    """Encodes whole texts to little-endian 16-bit ids (the vocabulary has fewer than 65,536)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        self.plain = Plain(self.tokenizer) if _shaped(self.tokenizer) and sys.byteorder == "little" else None
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0  # bytes of ``young``, about

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.young[word] = ids
        self.held += ENTRY + len(word) + len(ids)

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Encodes words, in parts of bounded size; returns those too long to be kept."""
        if self.plain is not None:
            short, words = [w for w in words if len(w) <= LONGEST], [w for w in words if len(w) > LONGEST]
            for start in range(0, len(short), 1 << 14):
                plain, ids, rest = self.plain.encode(short[start : start + (1 << 14)])
                for w, x in zip(plain, ids):
                    self._keep(w, x)
                words += rest
        long, start, total = {}, 0, 0
        for i, word in enumerate(words, 1):
            total += len(word)
            if i == len(words) or i - start == 4096 or total >= 1 << 18:
                part = words[start:i]
                found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
                for w, x in zip(part, found):
                    ids = np.array(x.ids, "<u2").tobytes()
                    if len(w) > LONGEST:
                        long[w] = ids
                    else:
                        self._keep(w, ids)
                start, total = i, 0
        return long

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes, with END_ID at the end; a null text is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        raw = pa.array([(t or "").encode("utf-8", "replace") for t in texts], pa.large_binary())
        split = pc.ascii_split_whitespace(raw.view(pa.large_string()))
        coded = split.flatten().view(pa.large_binary()).dictionary_encode()
        # a word has no blank in it; one may be empty, beside blanks at an end of a text
        met = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), pa.scalar(b"\n", pa.large_binary()))[0].as_py().split(b"\n") if len(coded) else []
        young, old = self.young, self.old
        new = []
        for word in met:
            if word not in young:
                if word in old:
                    self._keep(word, old[word])
                else:
                    new.append(word)
        long = self._learn(new)
        one, end = young.__getitem__, np.array([END_ID], "<u2").tobytes()
        if long:
            one = lambda w: long[w] if w in long else young[w]
        # the words' ids one after another, and where each text's begin and end in them
        ids = pa.array(list(map(one, met)), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)[split.offsets.to_numpy()].tolist() if len(ids) else [0] * (len(texts) + 1)
        data = memoryview(ids.buffers()[2] or b"")
        out = [bytes(data[a:b]) + end for a, b in itertools.pairwise(at)]
        if self.held > GENERATION:
            self.old, self.young, self.held = young, {}, 0
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, so that what it has learnt serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def text_batches(texts: list, limit: int = 1 << 20):
    """Slices of about ``limit`` characters, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def crc32_wide(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
