"""Token ids of whole texts through the ``tokenizers`` library, repeated words encoded once.

A byte-pair tokenizer never merges across the borders its pre-tokenizer draws. Texts are
therefore cut at borders that hold in any context, every distinct piece is encoded by the
library once per worker, and the ids of a text are put together from those of its pieces.
Texts for which a border is in doubt, and those that hold the string of a special token
(which the library reads as that token wherever it stands), go to the library whole.
"""

from __future__ import annotations

import os
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Pieces that a worker remembers, and as many words without their punctuation; beyond, it forgets
# those and starts anew. Known words make new pieces cheap. A million of both take some 400 MB.
MOST_PIECES = 1_000_000

# Letters up to Latin Extended-B with a tail of ASCII punctuation (but apostrophes, which start
# words such as 's): the library sees them as two words.
WORD = "^\n?[A-Za-zÀ-ÖØ-öø-ɏ]+$"
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

# Words that the library gets in one text.
WORDS_AT_ONCE = 1000

# White space other than single blanks and line feeds, where cutting at blanks is not safe. The class
# lists what Python's \s matches, for a regular expression engine that knows ASCII only.
DOUBTFUL = r"[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of texts, with ``end_id`` after each.

    ``blanks`` says that a blank belongs to the word behind it (byte-level vocabularies);
    otherwise white space separates words and is dropped.
    """

    def __init__(self, path: str, end_id: int, blanks: bool, most_pieces: int = MOST_PIECES):
        self.most_pieces = most_pieces
        self.tokenizer, self.end_id, self.blanks = load(path), end_id, blanks
        self.feed = self._library(["\n"])[0]
        # A token of a byte-level vocabulary has a character for each byte of the text.
        self.n_bytes = np.zeros(1 << 16, np.int64)
        self.ends_word = np.zeros(1 << 16, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.n_bytes[number] = len(token)
            self.ends_word[number] = token.endswith("</w>")
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        literal = ["".join(f"\\x{{{ord(c):x}}}" for c in token) for token in added]
        self.to_library = "|".join([*literal, *([DOUBTFUL] if blanks else [])])
        self.words = {"": b""}
        self._forget()

    def _forget(self) -> None:
        self.pieces: dict[str, int] = {}  # numbers from 1; 0 is the end id
        self.pool = np.zeros(1 << 16, np.uint16)
        self.pool[0] = self.end_id
        self.used = 1
        self.where = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)
        self.length[0] = 1

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """Pieces of texts. With ``blanks`` each piece but those led by a line feed has lost its blank."""
        if not self.blanks:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        feed, nothing = pa.scalar("\n", texts.type), pa.scalar("", texts.type)
        led = pc.binary_join_element_wise(feed, pc.replace_substring(texts, "\n", " \n"), nothing)
        return pc.split_pattern(led, " ")

    def _library(self, texts: list[str], whole: bool = False) -> list[bytes]:
        # Only whole texts can hold special strings; the library need not look for them in pieces.
        self.tokenizer.encode_special_tokens = not whole
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        self.tokenizer.encode_special_tokens = True
        return [np.array(x.ids, np.uint16).tobytes() for x in found]

    def _library_words(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, many in one text, that the library parts at their white space."""
        out: list[bytes] = []
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            if self.blanks:  # a word without blank comes behind a line feed, which is one id
                led = [w if w[0] == " " else "\n" + w for w in some]
            else:
                led = [" " + w for w in some]
            ids = self.tokenizer.encode_batch_fast(["".join(led)], add_special_tokens=False)[0].ids
            ids = np.array(ids, np.uint16)
            begins = np.zeros(len(some), np.int64)
            if self.blanks:
                upto = np.cumsum(self.n_bytes[ids])
                sizes = np.cumsum(np.fromiter((len(w.encode()) for w in led), np.int64, len(led)))
                ends = np.searchsorted(upto, sizes) + 1
                parted = upto[-1] == sizes[-1] and np.array_equal(upto[ends - 1], sizes)
                begins += np.fromiter((w[0] == "\n" for w in led), np.int64, len(led))
            else:
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                parted = len(ends) == len(some) and ends[-1] == len(ids)
            if not parted:
                out += self._library(some)
                continue
            begins[1:] += ends[:-1]
            raw = ids.tobytes()
            out += [raw[2 * a : 2 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        return out

    def _of_unknown(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces: those of their words where these are plain, else of the whole piece."""
        words = self.words
        column = pa.array(pieces, pa.large_string())
        core = pc.utf8_rtrim(column, characters=TAIL)
        is_plain = pc.match_substring_regex(core, WORD)
        core = pc.if_else(is_plain, core, column)
        is_led = pc.and_(is_plain, pc.starts_with(core, "\n"))
        core = pc.if_else(is_led, pc.utf8_slice_codeunits(core, 1), core)
        cores = core.to_numpy(zero_copy_only=False).tolist()
        plain, led = (x.to_numpy(zero_copy_only=False) for x in (is_plain, is_led))
        tails = [p[len(c) + f :] for p, c, f in zip(pieces, cores, led.tolist(), strict=True)]
        if self.blanks:  # a word behind a line feed has no blank; the line feed counts with it
            heads = [c if f or c[:1] == "\n" else " " + c for c, f in zip(cores, led.tolist(), strict=True)]
        else:
            heads = [c.lower() if p else c for c, p in zip(cores, plain.tolist(), strict=True)]
            heads = [p if p == h else h for p, h in zip(pieces, heads, strict=True)]  # one string in both tables
        new_words = [h for h in dict.fromkeys(compress(heads, plain)) if h not in words]
        words.update(zip(new_words, self._library_words(new_words), strict=True))
        others = [x for x in dict.fromkeys([*compress(heads, ~plain), *tails]) if x not in words]
        words.update(zip(others, self._library(others), strict=True))
        found = [words[h] + words[t] for h, t in zip(heads, tails, strict=True)]
        if self.blanks:
            for i in np.flatnonzero(led).tolist():
                found[i] = self.feed + found[i]
        return found

    def _store(self, found: list[bytes], first: int) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        last = first + len(found)
        while last > len(self.where):
            self.where = np.concatenate((self.where, np.zeros_like(self.where)))
            self.length = np.concatenate((self.length, np.zeros_like(self.length)))
        new = np.frombuffer(b"".join(found), np.uint16)
        while self.used + len(new) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(new)] = new
        self.where[first:last] = self.used + np.cumsum(sizes) - sizes
        self.length[first:last] = sizes
        self.used += len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (16 bits each), and how many each text has."""
        if len(self.pieces) > self.most_pieces:
            self._forget()
        if len(self.words) > self.most_pieces:
            self.words = {"": b""}
        column = pa.array(texts, pa.large_string())
        is_whole = np.zeros(len(texts), bool)
        if self.to_library:
            is_whole = pc.match_substring_regex(column, self.to_library).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(is_whole)
        if len(whole):  # one piece stands for the text
            column = pc.if_else(pa.array(is_whole), pa.scalar("", column.type), column)
        cut = self._cut(column)
        n_pieces = np.diff(cut.offsets.to_numpy())
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.pieces.get, distinct, repeat(0)), np.int64, len(distinct))
        new = number == 0
        unknown = list(compress(distinct, new))
        if unknown:
            first = len(self.pieces) + 1
            number[new] = np.arange(first, first + len(unknown))
            self._store(self._of_unknown(unknown), first)
            self.pieces.update(zip(unknown, number[new].tolist(), strict=True))
        ends = np.cumsum(n_pieces + 1)
        begins = ends - n_pieces - 1
        numbers = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        numbers[np.arange(len(coded)) + np.repeat(np.arange(len(texts)), n_pieces)] = number[coded.indices.to_numpy()]
        if len(whole):  # beside the table: these are not remembered
            base = len(self.pieces) + 1
            used = self.used
            self._store(self._library([texts[i] for i in whole], whole=True), base)
            numbers[begins[whole]] = np.arange(base, base + len(whole))
        sizes = self.length[numbers].astype(np.int64)
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        at = np.repeat(self.where[numbers] - (upto - sizes), sizes)
        at += np.arange(total)
        ids = self.pool[at]
        if len(whole):
            self.used = used
        stops = upto[ends - 1]
        counts = np.diff(stops, prepend=0)
        # With blanks the first piece was led by a line feed that the text does not have.
        if self.blanks and len(texts):
            led = ~is_whole
            drop = np.ones(total, bool)
            drop[(stops - counts)[led]] = False
            ids, counts = ids[drop], counts - led
        return ids, counts


_LOADED: dict[tuple, WordIds] = {}


def word_ids(path: str, end_id: int, blanks: bool, most_pieces: int = MOST_PIECES) -> WordIds:
    """One per worker and tokenizer, so that what it remembers serves later tasks too."""
    key = (path, end_id, blanks, most_pieces)
    if key not in _LOADED:
        _LOADED[key] = WordIds(*key)
    return _LOADED[key]
