"""Public vocabulary files, opened once per worker. Paths are parameters; nothing is trained or copied."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

from .textarrays import WordTable, look_up_texts


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file, by token."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, as byte values by letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class JsonVocabulary:
    """A byte-level BPE of the tokenizers library: its vocabulary as ranks, and its added tokens.

    Where every merge makes the next id, merging by the id of the result is the
    same as merging by the order of the list; then tiktoken's compiled merge loop
    gives the library's ids. Any other file is left to the library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        self.plain = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and all(a < b for a, b in zip(made, made[1:]))
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec.get("added_tokens", []))
        )
        self.ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.special} if self.plain else {}
        self._table: WordTable | None = None
        self._library = None

    def encode(self, texts: list[str]) -> list:
        """Arrays of ids, as ``encode_batch(texts, add_special_tokens=False)`` of the library gives them."""
        if not self.plain:
            return self.by_library(texts)
        if self._table is None:
            import public_tokenizers
            import tiktoken

            words = tiktoken.Encoding("from_json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
            self._table = WordTable(lambda found: list(map(words.encode_ordinary, found)))
        return look_up_texts(self._table, texts, self.special)

    def by_library(self, texts: list[str]) -> list:
        import numpy as np
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return [np.array(e.ids, np.int32) for e in self._library.encode_batch(texts, add_special_tokens=False)]


@lru_cache(maxsize=2)
def json_vocabulary(path: str) -> JsonVocabulary:
    return JsonVocabulary(path)
