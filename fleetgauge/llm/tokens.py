"""Token ids of whole texts, encoding each distinct run of characters once per worker.

White space ends a token of these tokenizers and is dropped, so a text's ids
are those of its white-space-separated runs in a row.  Runs repeat a lot: a
worker keeps the ids of the runs it has met.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

# Runs a worker remembers before it starts over: bounds its memory to some 150 MB.
REMEMBERED = 600_000
# Letters below this code point compose with nothing and have one lower case each, but for the one excluded.
_PLAIN_BELOW = 0x250
_NOT_PLAIN = re.compile(f"[İ{chr(_PLAIN_BELOW)}-\U0010ffff\x00-\x20\x7f-\xa0]|<\\|")


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


class RunIds(dict):
    """Run of UTF-8 bytes without white space -> its ids as little-endian unsigned 32-bit integers.

    Runs of the Latin blocks go straight to the tokenizer's merges, all others
    through the whole tokenizer, whose normaliser is the slow part.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from array import array

        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._merge = self._tokenizer.model.tokenize
        self._array = array
        self._letters = _byte_letters()
        self._parts = re.compile(_parts(json.loads(tokenizer_json)))

    def __missing__(self, run: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        text = run.decode()
        if _NOT_PLAIN.search(text):
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = []
            for part in self._parts.findall(text.lower()):
                ids += [t.id for t in self._merge(part.encode().decode("latin-1").translate(self._letters))]
        found = self[run] = self._array("I", ids).tobytes()
        return found

    def of_text(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        # Added tokens are matched before letters are lowered; where one could stand, letters stay as they are.
        runs = text.split() if b"<|" in text else text.lower().split()
        return b"".join(map(self.__getitem__, runs))


def _parts(tokenizer: dict) -> str:
    """The tokenizer's own split pattern, its letter and number classes spelt out for the Latin blocks."""
    split = tokenizer["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(_PLAIN_BELOW) if unicodedata.category(chr(c))[0] == kind)

    return split.replace(r"\p{L}", members("L")).replace(r"\p{N}", members("N"))
