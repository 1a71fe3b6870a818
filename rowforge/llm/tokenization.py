"""Token ids of a byte-level BPE vocabulary file (the JSON form of the ``tokenizers`` library).

Where the file is plain byte-level BPE whose merges come in the order of the ids, the same ids are computed by ``tiktoken``
from the vocabulary read from that file, about four times as fast; any other file goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np

#: Fixed value: the split pattern of byte-level pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str, fast: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = 1 + max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec["added_tokens"])])
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._fast = self._tiktoken(spec) if fast else None
        self._slow = None
        if self._fast is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(path)

    def _tiktoken(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return None
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [vocab[m] for m in merges]
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or len(vocab) != 256 + len(merges):
            return None
        import tiktoken

        of = _bytes_of_symbols()
        ranks = {bytes(of[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> list[int]:
        if self._fast is None:
            return self._slow.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self._fast.encode(text, allowed_special="all")
        return self._fast.encode_ordinary(text)

    def arrays(self, texts: list[str | None], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with ``end`` behind them; null counts as empty."""
        last = [] if end is None else [end]
        return [np.array(self.encode(t or "") + last, dtype=np.uint32) for t in texts]


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each path and worker."""
    return Vocabulary(path)
