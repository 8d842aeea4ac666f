"""Cut texts where no token can cross, so that a worker keeps the result of each distinct chunk.

The cuts below are proven by the tokenizer's own pre-tokenisation, read from its file; a file
with other rules, and a text that spells a special token, are given whole to the library.
Everything here is a pure function of the text: the memory of chunks changes time, not results.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np

# Before one of these letters or digits a full stop or comma starts a new pre-token.
LETTER = "A-Za-z0-9À-ÖØ-öø-ÿ"


LONG_TEXT = 1 << 18  # characters above which a text is cut in stretches, so that its chunks need not all be held at once


def stretches(text: str, gap: re.Pattern) -> Iterator[str]:
    """The text in order, cut at the first ``gap`` after each ``LONG_TEXT`` characters."""
    at = 0
    while len(text) - at > LONG_TEXT and (found := gap.search(text, at + LONG_TEXT)):
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


class Remembered:
    """chunk -> value, computed by ``fill`` for whole batches of unknown chunks; at most ``most`` chunks are kept."""

    def __init__(self, fill: Callable[[list[str]], list], most: int = 1_500_000, longest: int = 64):
        self.fill, self.most, self.longest = fill, most, longest
        self.known: dict[str, object] = {}

    def values(self, parts: list[list[str]]) -> list[list]:
        found = [list(map(self.known.get, p)) for p in parts]
        holes = []
        for f in found:
            at, i = [], -1
            for _ in range(f.count(None)):
                i = f.index(None, i + 1)
                at.append(i)
            holes.append(at)
        missing = list(dict.fromkeys(p[i] for p, h in zip(parts, holes) for i in h))
        if missing:
            fresh = dict(zip(missing, self.fill(missing)))
            for p, f, h in zip(parts, found, holes):
                for i in h:
                    f[i] = fresh[p[i]]
            if len(self.known) + len(fresh) > self.most:
                self.known.clear()
            self.known.update((c, v) for c, v in fresh.items() if len(c) <= self.longest)
        return found


class LibraryEncoder:
    """Ids as the tokenizers library gives them for whole texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in rules["added_tokens"]) or r"(?!)")
        before, words = rules["normalizer"], rules["pre_tokenizer"] or {}
        model = rules["model"]
        plain = model["type"] == "BPE" and not model["dropout"] and not model["ignore_merges"] and rules["post_processor"] is None
        self.kind = "whole"
        if plain and before is None and words.get("type") == "ByteLevel" and words["use_regex"] and not words["add_prefix_space"]:
            self.kind = "byte"  # white space opens a pre-token, never ends one before a letter
        elif plain and words.get("type") == "Sequence" and words["pretokenizers"][0].get("behavior") == "Removed" \
                and r"[^\s\p{L}\p{N}]+" in words["pretokenizers"][0]["pattern"]["Regex"]:
            self.kind = "word"  # white space is dropped
        # A stop after anything but a letter, and white space after white space: searched from the second character.
        self.unsafe = [re.compile(rf"[.,](?<=[^{LETTER}].)"), re.compile(r"[ \n](?<=\s[ \n])")] if self.kind == "byte" else [
            re.compile(rf"[.,](?<=[^{LETTER} \n].)")]
        self.gap = re.compile(r"(?<=\S)(?=[ \n])")
        self.memory = Remembered(self._chunks)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The library's model on chunks that are one pre-token whatever the rules, the whole library on the others."""
        out: list[bytes | None] = []
        model, byte = self.tokenizer.model, self.kind == "byte"
        for c in chunks:
            letters = c[1:] if byte and c[:1] == " " else c
            if letters.isascii() and letters.isalpha():
                # Byte-level pre-tokenisation writes a space as U+0120; the other file lowers its input.
                word = "\u0120" * (len(c) - len(letters)) + letters if byte else letters.lower()
                out.append(np.array([t.id for t in model.tokenize(word)], dtype="<u4").tobytes())
            else:
                out.append(None)
        rest = [i for i, v in enumerate(out) if v is None]
        for i, v in zip(rest, self._library([chunks[i] for i in rest])):
            out[i] = v
        return out

    def cut(self, text: str) -> list[str]:
        unsafe = "\0" in text or any(r.search(text) for r in self.unsafe)
        if self.kind == "byte":
            if unsafe:
                return self.gap.split(text)
            text = text.replace(" ", "\0 ").replace("\n", "\0\n")
        else:
            if unsafe:
                return re.split("[ \n]", text)
            text = text.replace(" ", "\0").replace("\n", "\0")
        return text.replace(",", "\0,").replace(".", "\0.").split("\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One value per text; a null text is empty."""
        texts = [t or "" for t in texts]
        whole = [i for i, t in enumerate(texts) if self.kind == "whole" or self.special.search(t)]
        apart = set(whole)
        rest = [i for i in range(len(texts)) if i not in apart]
        out: list[bytes] = [b""] * len(texts)
        long = [i for i in rest if len(texts[i]) > LONG_TEXT]
        for i in long:
            out[i] = b"".join(b"".join(self.memory.values([self.cut(s)])[0]) for s in stretches(texts[i], self.gap))
        rest = [i for i in rest if len(texts[i]) <= LONG_TEXT]
        for at in range(0, len(rest), 64):
            some = rest[at:at + 64]
            for i, v in zip(some, self.memory.values([self.cut(texts[i]) for i in some])):
                out[i] = b"".join(v)
        for i, v in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = v
        return out


_ENCODERS: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """One per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]
