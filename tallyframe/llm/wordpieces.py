"""Token ids of whole texts by a `tokenizers` file whose words end in a token of their own, with words' ids kept.

Pre-tokens never cross white space and merges never cross pre-tokens, so the ids of a text are those of its words in
turn. Words that aren't kept are encoded many at a time and their ids told apart by the mark that ends a pre-token.
That holds for texts of the characters in PLAIN, whose classes and lower case no Unicode version changes; any other
text, and one that holds a special token, is encoded whole.
"""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np

#: Characters for which words and pre-tokens are found here.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ž]*")
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ž"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Words whose ids a worker keeps, the first it meets.
MOST_KEPT = 600_000


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _kept(path: str) -> dict[str, bytes]:
    return {}


@cache
def _ends(path: str) -> np.ndarray:
    """For each id whether it ends a pre-token."""
    tok = _tokenizer(path)
    mark = json.loads(tok.to_str())["model"]["end_of_word_suffix"]
    out = np.zeros(tok.get_vocab_size(), bool)
    out[[k for t, k in tok.get_vocab().items() if t.endswith(mark)]] = True
    return out


def _bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _words(words: list[str], path: str) -> list[bytes]:
    """The ids of each word."""
    tok, out = _tokenizer(path), []
    for k in range(0, len(words), 512):
        some = words[k : k + 512]
        many = [len(PRETOKEN.findall(w)) for w in some]
        ids = np.asarray(tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(0, np.flatnonzero(_ends(path)[ids]) + 1)
        if len(ends) != sum(many) + 1:
            out.extend(_bytes(tok.encode(w, add_special_tokens=False).ids) for w in some)
            continue
        cut = (ends[np.cumsum([0, *many])] * 4).tolist()
        raw = ids.tobytes()
        out.extend(raw[s:e] for s, e in zip(cut, cut[1:], strict=False))
    return out


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text, little-endian unsigned 32-bit."""
    tok, kept = _tokenizer(path), _kept(path)
    split = [x.lower().split() if PLAIN.fullmatch(x) and not any(s in x for s in SPECIAL) else None for x in texts]
    new = list({w for words in split if words for w in words if w not in kept})
    over = new[max(0, MOST_KEPT - len(kept)) :]
    kept.update(zip(new, _words(new, path), strict=True))
    out = [_bytes(tok.encode(x, add_special_tokens=False).ids) if words is None else b"".join(map(kept.__getitem__, words)) for x, words in zip(texts, split, strict=True)]
    for w in over:
        del kept[w]
    return out
