"""Token ids by the tokenizers library, with the pieces of a text remembered.

A pre-token never reaches over a space that stands between two visible characters: it ends before it, and the next one starts with it (or drops it).
Nor does it hold both a letter or digit and a full stop or comma behind it, and a single line feed between visible characters is one by itself.
So a text may be cut before such spaces, stops and commas and around such line feeds, and pieces that recur need the library only once. Ids are the same as for the whole text.
"""

from __future__ import annotations

import array
import os
import re

import numpy as np

from vitalcov.llm.common import worker_state

#: Before a space that stands between two characters that are surely visible, composed and no combining marks.
CUT = re.compile(r"(?<=[!-~¡-¬®-ɏ])(?= [!-~¡-¬®-ɏ])")


def _kind(code: int) -> str:
    """Of a character below 256: letter or digit, space or line feed, stop or comma, other visible one, or the rest."""
    char = chr(code)
    if char in " \n":
        return " "
    if char in ".,":
        return "."
    if code < 32 or 127 <= code <= 160 or code == 173:
        return "?"
    return "a" if char.isalpha() or char in "0123456789" else "*"


KINDS = "".join(map(_kind, range(256))).encode("ascii")
#: Single pre-tokens of a byte-level vocabulary, surely, one a line.
LETTERS = re.compile("^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$", re.M)
#: Bytes without a visible character of their own (but the line feed) are, in their order, the characters from 256 on.
_HIDDEN = [b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)}]
VISIBLE = [(chr(b), chr(256 + k)) for k, b in enumerate(_HIDDEN) if b == 32 or b > 126]


def cut(text: str) -> list[str]:
    """The pieces of `text`, by plain replacement where no space or stop stands in an unusual place."""
    try:
        kinds = text.encode("latin-1").translate(KINDS)
    except UnicodeEncodeError:
        return CUT.split(text)
    if b"?" in kinds or b"  " in kinds or kinds[:1] == b" " or kinds[-1:] == b" ":
        return CUT.split(text)
    text = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
    if b".." not in kinds and b" ." not in kinds and b"*." not in kinds:
        text = text.replace(".", "\0.").replace(",", "\0,")
    return text.split("\0")


class Pieces(dict):
    """Little-endian 32-bit ids of pieces.

    A piece seen for the first time waits among the `fresh` ones; seen again, it moves here. When `fresh` is full it starts anew, so memory is bounded
    and what stays are pieces that recur.

    With a byte-level vocabulary, an unknown piece of Latin letters with at most one space before them is a single pre-token, and the library's model takes it as it is.
    Other unknown pieces are encoded many at a time: one text in which a mark of a single token stands between them.
    Pieces that hold the mark or white space at their end, and texts that do not come back with one token for each mark, go one by one.
    """

    def __init__(self, tokenizer, mark: str, limit: int):
        self.tokenizer, self.mark, self.limit = tokenizer, mark, limit
        self.fresh: dict[str, bytes] = {}
        self.between = mark if mark.isspace() else f" {mark} "
        ids = self.encoded(f"a{self.between}a")
        self.mark_id = int(ids[1]) if len(ids) == 3 else -1
        # byte-level: the model knows each byte as a visible character, and nothing changes the text before
        alphabet = tokenizer.pre_tokenizer.pre_tokenize_str("".join(map(chr, [32, *range(33, 127)]))) if tokenizer.pre_tokenizer else []
        self.direct = tokenizer.normalizer is None and "".join(x for x, _ in alphabet)[:2] == "\u0120!" and self.same_directly()

    def same_directly(self) -> bool:
        """Whether the model gives the library's ids for some single pre-tokens."""
        some = ["the", " of", " Straße", "éÀÿíà", " I", " unforeseeable"]
        return self.directly(some) == [self.encoded(p).tobytes() for p in some]

    def directly(self, pieces: list[str]) -> list[bytes]:
        """Ids of single pre-tokens, by the model alone."""
        shown, tokenize = "\n".join(pieces).encode().decode("latin-1"), self.tokenizer.model.tokenize
        for byte, char in VISIBLE:
            shown = shown.replace(byte, char)
        return [array.array("I", [t.id for t in tokenize(p)]).tobytes() for p in shown.split("\n")]

    def __missing__(self, piece: str) -> bytes:
        return self.fresh[piece]

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def singly(self, wanted: list[str]) -> None:
        for piece, found in zip(wanted, self.tokenizer.encode_batch_fast(wanted, add_special_tokens=False), strict=True):
            self.fresh[piece] = np.array(found.ids, "<u4").tobytes()

    def learn(self, wanted: set[str]) -> None:
        new, fresh = [], self.fresh
        for piece in wanted - self.keys():
            if piece in fresh:
                if len(self) < self.limit:
                    self[piece] = fresh[piece]
            else:
                new.append(piece)
        if len(fresh) + len(new) > self.limit * 3 // 4:
            self.fresh = fresh = {p: fresh[p] for p in wanted & fresh.keys()}
        if self.direct:
            letters = LETTERS.findall("\n".join(p for p in new if "\n" not in p))
            if letters:
                fresh.update(zip(letters, self.directly(letters), strict=True))
                new = [p for p in new if p not in fresh]
        mark = self.mark
        easy = [p for p in new if mark not in p and p and not p[-1].isspace()] if self.mark_id >= 0 else []
        if len(easy) < len(new):
            self.singly(list(set(new) - set(easy)))
        for at in range(0, len(easy), 1000):
            part = easy[at : at + 1000]
            ids = self.encoded(self.between.join(part))
            marks = np.flatnonzero(ids == self.mark_id)
            if len(marks) != len(part) - 1:
                self.singly(part)
                continue
            data = ids.tobytes()
            starts, ends = [0, *(4 * marks + 4).tolist()], [*(4 * marks).tolist(), len(data)]
            fresh.update(zip(part, [data[x:y] for x, y in zip(starts, ends, strict=True)], strict=True))


class Encoder:
    """`spaced`: the vocabulary marks a leading space (byte-level); otherwise white space is dropped."""

    def __init__(self, path: str, spaced: bool, limit: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.literal = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pieces = Pieces(self.tokenizer, "\n" if spaced else "~", limit)

    def parts(self, text: str) -> list[str]:
        """The pieces of `text`; an added token that stands in it literally is one, as the library looks for these first and takes what is between as texts of their own."""
        if not any(a in text for a in self.added):
            return cut(text)
        return [p for k, x in enumerate(self.literal.split(text)) for p in ([x] if k % 2 else cut(x))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian 32-bit integers."""
        parts = [self.parts(t) for t in texts]
        self.pieces.learn(set().union(*parts))
        return [b"".join(map(self.pieces.__getitem__, p)) for p in parts]


def encoder(path: str, spaced: bool) -> Encoder:
    return worker_state(f"encoder {path} {spaced}", lambda: Encoder(path, spaced))
