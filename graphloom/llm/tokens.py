"""Exact token ids of whole texts with a memo over white-space separated fields.

Where a vocabulary's pre-tokenizer drops white space, and no normalizer step or added token spans it, a text's ids
are those of its fields one after the other. ``splits_at_space`` reads that from the vocabulary's own rules when it is
loaded; where it is not so, whole texts go to the library. A field met before costs a lookup. A new field that is a run
of Latin letters and closing punctuation splits once more, at the border the pre-tokenizer has there as well, which is
tried out on loading; the letters go straight to the library's BPE model, all other fields to the whole library
tokenizer. The memos hold a bounded number of entries, and clearing them changes only the speed.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Latin letters whose lower case is one letter and that are in composed form; then closing punctuation.
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ]+)([.,!?;:*%$&#|]*)")
#: What stands between ASCII white space.
FIELD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
MAX_FIELDS = 600_000
MAX_CORES = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _kinds(rule: dict | None, inner: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer, sequences unfolded."""
    if rule is None:
        return []
    return [s for r in rule[inner] for s in _kinds(r, inner)] if rule["type"] == "Sequence" else [rule]


def splits_at_space(full: Tokenizer) -> bool:
    """Whether by its rules no id of a text depends on what stands beyond white space.

    Normalizers may compose, lower letters and change runs of white space; the pre-tokenizer's first step must drop all
    that a pattern without white space leaves; no added token has white space or strips it; merging is not random.
    """
    rules = json.loads(full.to_str())
    for step in _kinds(rules["normalizer"], "normalizers"):
        spaces = step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " "
        if step["type"] not in ("NFC", "NFD", "Lowercase") and not spaces:
            return False
    first, *rest = _kinds(rules["pre_tokenizer"], "pretokenizers") or [{"type": ""}]
    if first["type"] != "Split" or first["behavior"] != "Removed" or not first["invert"] or "Regex" not in first["pattern"]:
        return False
    # no alternative may match white space: it is named only in negated classes, and no dot or negation lets it in
    pattern = re.sub(r"\[\^[^\]]*\\s[^\]]*\]", "", first["pattern"]["Regex"])
    if re.search(r"\s|\\s|\\S|\\W|\\D|\\P|\\n|\\t|\\r|\[\^|\.|\(\?", pattern):
        return False
    if any(s["type"] != "ByteLevel" or s["add_prefix_space"] or s["use_regex"] for s in rest):
        return False
    if any(t["lstrip"] or t["rstrip"] or FIELD.fullmatch(t["content"]) is None or t["content"].split() != [t["content"]] for t in rules["added_tokens"]):
        return False
    return rules["model"]["type"] == "BPE" and not rules["model"].get("dropout")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Cores(dict):
    def __init__(self, model, code: str) -> None:
        self.model, self.code = model, code
        letters = _byte_letters()
        self.table = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x180)}

    def __missing__(self, core: str) -> bytes:
        if len(self) >= MAX_CORES:
            self.clear()
        ids = array(self.code, [t.id for t in self.model.tokenize(core.translate(self.table))]).tobytes()
        self[core] = ids
        return ids


class FieldEncoder(dict):
    """Maps a field's UTF-8 bytes to the bytes of its ids."""

    def __init__(self, path: str) -> None:
        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.spaced = splits_at_space(self.full)
        self.size = self.full.get_vocab_size(with_added_tokens=True)
        self.code = "H" if self.size <= 65_536 else "I"
        self.dtype = np.dtype(self.code)
        self.cores = _Cores(self.full.model, self.code)
        self.marks: dict[str, bytes] = {"": b""}
        self.plain = self.spaced and self._plain()

    def _plain(self) -> bool:
        """Whether letters may go to the model alone; tried out on a text rather than assumed."""
        probe = "Straße, naïve ÉTÉ. œuvre!! the"
        want = self.full.encode(probe, add_special_tokens=False).ids
        got: list[int] = []
        for field in probe.split():
            found = _SIMPLE.fullmatch(field)
            got += np.frombuffer(self.cores[found[1].lower()], self.dtype).tolist()
            got += self.full.encode(found[2], add_special_tokens=False).ids if found[2] else []
        return want == got

    def whole(self, text: str) -> bytes:
        return array(self.code, self.full.encode(text, add_special_tokens=False).ids).tobytes()

    def field(self, field: bytes) -> bytes:
        """A field's ids, without the memo of fields."""
        text = field.decode()
        found = _SIMPLE.fullmatch(text) if self.plain else None
        if found is None:
            return self.whole(text)
        end = self.marks.get(found[2])
        if end is None:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            end = self.marks[found[2]] = self.whole(found[2])
        return self.cores[found[1].lower()] + end

    def __missing__(self, field: bytes) -> bytes:
        if len(self) >= MAX_FIELDS:
            self.clear()
        ids = self[field] = self.field(field)
        return ids

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; none for null."""
        if not self.spaced:
            return np.frombuffer(self.whole(text or ""), self.dtype)
        return np.frombuffer(b"".join(map(self.__getitem__, (text or "").encode().split())), self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> FieldEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    return FieldEncoder(path)
