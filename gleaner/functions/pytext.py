"""The text functions of ``text.py`` for use inside Arrow functions: its patterns, compiled for Python."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa

from gleaner.functions import text as columns


def _compiled(pattern: str) -> re.Pattern[str]:
    """A Java pattern: code points in braces, and a Unicode flag that Python needs not."""
    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{m[1]:0>4}", pattern.replace("(?U)", "")))


_INVISIBLE, _BETWEEN, _PAGE_NUMBER = map(_compiled, (columns.INVISIBLE, columns.BETWEEN, columns.PAGE_NUMBER))
_HEADING = _compiled("|".join(f"(?:{p})" for p in columns.HEADINGS))
_MARKUP = [(_compiled(pattern), rf"\{group}" if group else "") for pattern, group in columns.MARKUP]


_TOKEN = _compiled(columns.TOKEN)


def pairs(run: str) -> list[str]:
    """A run of CJK characters as overlapping pairs: the stand-in for segmentation by a dictionary."""
    return [run[i : i + 2] for i in range(max(1, len(run) - 1))]


def tokens(text: str, segment: Callable[[str], list[str]] = pairs) -> list[str]:
    """Search tokens of a text, in order."""
    found = _TOKEN.findall(unicodedata.normalize("NFKC", text).casefold())
    return found if text.isascii() else [t for unit in found for t in (segment(unit) if unit[0] >= "\u3400" else (unit,))]


#: Characters of tokens that need more than a look at their neighbours.
_OTHER = _compiled(rf"[\x{{131}}{columns.CJK}]")
_PLAIN, _JOINER = (np.isin(np.arange(256), np.frombuffer(own, np.uint8)) for own in (b"abcdefghijklmnopqrstuvwxyz0123456789", b"._/+-"))


def token_lists(texts: pa.Array) -> pa.ListArray:
    """Search tokens of each text, found in all of them at once: stretches of ASCII letters and digits and of joiners between two of them. A null has none.

    Texts with other characters in their tokens are gone through one by one.
    """
    plain, others = [], {}
    for i, text in enumerate(texts.to_pylist()):
        if text and not text.isascii():
            folded = unicodedata.normalize("NFKC", text).casefold()
            if _OTHER.search(folded):
                others[i] = tokens(text)
            plain.append(b"" if i in others else folded.encode("ascii", "replace"))
        else:
            plain.append((text or "").lower().encode())
    data = np.frombuffer(b"".join(t + b"\n" for t in plain), np.uint8)
    letter = _PLAIN[data]
    own = letter.copy()
    own[1:-1] |= _JOINER[data[1:-1]] & letter[:-2] & letter[2:]
    before = np.concatenate([[0], np.cumsum(own, dtype=np.int32)])  # of each place the bytes of tokens before it
    edges = np.flatnonzero(np.diff(own, prepend=False, append=False))
    begins = edges[::2]
    lists = np.concatenate([[0], np.searchsorted(begins, np.cumsum([len(t) + 1 for t in plain]))]).astype(np.int32)
    offsets = np.append(before[begins], before[-1]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(data[own]))
    found = pa.ListArray.from_arrays(pa.array(lists), words)
    if others:
        order = np.arange(len(plain))
        order[list(others)] = len(plain) + np.arange(len(others))
        found = pa.concat_arrays([found, pa.array(list(others.values()), pa.list_(pa.string()))]).take(pa.array(order))
    return found


def joined_tokens(texts: pa.Array) -> list[str]:
    """The search tokens of each text without anything between them."""
    found = token_lists(texts)
    words, lists = found.values, found.offsets.to_numpy()
    ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset :], words.buffers()[2]
    return pa.StringArray.from_buffers(len(found), pa.py_buffer(ends[lists]), data).to_pylist()


def clean_block(text: str) -> str:
    seen = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return _BETWEEN.sub("", " ".join(seen.split()))


def strip_markdown(text: str) -> str:
    return clean_block(reduce(lambda t, rule: rule[0].sub(rule[1], t), _MARKUP, text))


def is_heading(line: str) -> bool:
    return 0 < len(line) <= 100 and line[-1] not in columns.CLOSING and bool(_HEADING.search(line))


def is_page_number(line: str) -> bool:
    return bool(_PAGE_NUMBER.match(line))
