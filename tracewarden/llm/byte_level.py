"""What both tokenizer operators share: the byte-level pre-tokenizer, its special strings and a bounded memo."""

from __future__ import annotations

import json
import re

import public_tokenizers
import regex

#: Words that a memo holds in each of its two generations.
REMEMBERED = 200_000
#: Longer words are made anew each time, so that a memo's bytes are bounded too.
LONGEST = 128


class Memo(dict):
    """A dict that makes missing values; when full it becomes the old generation, from which used entries come back."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def read_vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def is_byte_level(spec: dict) -> bool:
    """True where texts fall into words by the byte-level pattern alone, so that words can be encoded one by one."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    return plain and added and not spec.get("normalizer") and spec["model"]["type"] == "BPE"


class Words:
    """Splits texts as the byte-level pre-tokenizer does; special strings stay whole and are marked."""

    def __init__(self, spec: dict):
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.word = regex.compile(public_tokenizers.PATTERN)

    def __call__(self, text: str) -> list[str]:
        if not self.special or not any(s in text for s in self.special):
            return self.word.findall(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.word.findall(part)
        return out
