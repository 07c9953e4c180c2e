"""Personal data: exact base patterns, then a linear-chain CRF over word shapes.

The base spans follow fixed patterns and never change. The CRF is trained from
the small labelled table below, with features of a word's shape, sizes and
neighbours, by exact gradients of the log likelihood (forward-backward).
Every word of every line of every text is decoded, by Viterbi over all lines
of a batch at once. CRF spans that touch a base span are dropped, the rest are
added.

Rows: null and empty texts have no spans; repeated rows are searched each; a
null doc_id stays null; extra columns are ignored, or kept by ``mask``; an
empty table gives no rows. Ties between labels go to the first listed.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import documents, prepare
from tidewright.llm.textunits import slices, words

BASE_KINDS = ["email", "ip", "card", "phone"]
CRF_KINDS = ["card", "id", "phone", "secret", "name", "address"]
BATCH = 60_000

_KINDS = list(dict.fromkeys([*BASE_KINDS, *CRF_KINDS]))

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = np.zeros(128, bool)
_LOCAL[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches in one pass: each @ takes the run of local characters before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and ord(c := text[start - 1]) < 128 and _LOCAL[ord(c)]:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, m.end()
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in the order of kinds, then of starts; offsets in code points."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _ip_matches(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _ip_matches(text: str):
    """Matches of the ip pattern; a run of digits only matches from its start or from where the last match ended."""
    return _IP.finditer(text) if "." in text else ()


# Labelled table. A line's {kind} is a span, written in one of the kind's forms; in forms 9 is any digit, A a capital, a a
# small letter, h and H hex digits, x a letter or digit and \ keeps the next character. In lines and forms ~ is an
# invented word, in lines ^ one with a capital, _ one in capitals, and 9 any digit.
FORMS = {
    "phone": ["555-9999", "555 9999", "(999) 555-9999", "+1 (999) 555-9999", "+99 99 9999 9999", "999-555-9999", "999.555.9999", "09999 999999", "099-9999999", "99.99.99.99.99", "+999999999999", "0999 999 9999"],
    "phone+": ["+1 (999) 555-9999", "+99 99 9999 9999", "+999999999999", "(999) 555-9999"],
    "card": ["4999999999999999", "4999 9999 9999 9999", "5599-9999-9999-9999", "9999999999999999", "379999999999999", "6099 9999 9999 9999"],
    "id": ["999-99-9999", "DE99999999999999999999", "AA99AAAA99999999999999", "A99A99A99", "AA999999A", "A99999999", "GB99 AAAA 9999 9999 9999 99"],
    "id+": ["999-99-9999", "DE99999999999999999999", "AA99AAAA99999999999999", "GB99 AAAA 9999 9999 9999 99"],
    "secret": ["hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh", "HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH", "sk-xxxxxxxxxxxxxxxxxxxxxxxx", "\\AKI\\AAAAAAAAA9AAAAAAA", "aaaaaa9aa99", "~~~", "Aaaaaaa!9", "~-~-~-~", "xxxxxxxxxxxxxxxx", "aaaaaaaaaa"],
    "secret+": ["hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh", "hhhhhhhhhhhhhhhhhhhhhhhhhhhhhhhh", "HHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHHH", "sk-xxxxxxxxxxxxxxxxxxxxxxxx", "ghp_xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "\\AKI\\AAA9AA9AAA9AAAAAA", "\\AKI\\AAAAAAAAA9AAAAAAA", "eyJxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx"],
    "name": ["Aaaaa Aaaaaa", "Aaaa Aaaaa", "Aaaaaa A. Aaaaa", "Aaaaa Aaaaa-Aaaaaa"],
    "address": ["99 Aaaaa Street", "999 Aaaaaa Road", "9 Aaaaa Avenue", "99 Aaaa Lane", "Aaaaastrasse 99", "99 rue de Aaaaaa", "9999 Aaa Aaaaa Drive", "99 Aaaaa St."],
}
LABELLED = """
call {phone} before noon
her number is {phone} at work
his number is {phone} now
phone {phone} or {phone} today
ring {phone} for help
the office, {phone}, opens late
tel: {phone} for orders
reach me on {phone} tonight
my mobile is {phone}
text {phone} to win
fax: {phone} or write
dial {phone} and wait
~ ~ {phone+} ~ ~ ~
~. ~ {phone+} ~
^ {phone+} ~ ~. ^ ~
~ the {phone+}, ~ ~
_!! {phone+}!! _!! _!!
| ~ | {phone+} | ~ |
card {card} was charged
paid with {card} last week
her card {card} expired
charge {card} again
~ ~ {card} ~ ~
~ the {card} ~. ~
~ ~. {card} ^ ~
{card} ~ ~ ~
| ~ | {card} | ~ |
~ of {card}!! ~!! ~!!
card number {card} is old
visa {card} declined
ssn {id} on file
number {id} belongs to him
IBAN {id} for transfers
account {id} is closed
passport {id} was lost
passport no. {id} expired
national insurance {id} is valid
social security number {id} please
his id {id} was copied
~ ~ {id+} ~ ~
~ the {id+}, ~ ~. ^
| ~ | {id+} | ~ |
token = "{secret}" and more
~ ~ token = "{secret}" ~ ~
| ~ | token = "{secret}" | ~ |
the api key {secret+} was leaked
the api key is {secret} now
api_key: "{secret}"
key {secret+} used
password: {secret} works
password: {secret}
the password: {secret} and more
login with password: {secret}
password is {secret} now
the password {secret+} was changed
password = {secret}
passphrase: {secret} ok
secret = {secret} here
export KEY="{secret+}" now
bearer {secret+} in the header
Authorization: Bearer {secret+}
access token {secret+} expired
~ ~ {secret+} ~ ~
~ {secret+}, ~. ~
my name is {name} and
signed by {name} on
Mr. {name} said so
Mrs. {name} came
Dr. {name} works here
Dr. {name} was there
Mr. {name} and
Ms. {name} is away
the letter of Mrs. {name} arrived
Prof. {name} wrote
name: {name}
full name: {name}
her name is {name}
I am {name} from
sincerely, {name}
yours, {name}
email {name} about it
Dear {name},
contact {name} at work
patient {name} was seen
lives at {address} with
home address: {address}
ship it to {address} by noon
moved to {address} in May
the house at {address} is
address: {address}
he lives at {address}
delivered to {address} today
visit us at {address} or
~ ~ {address} ~ ~
in 1999 there were 12 cases and 3.5 percent
version 2.0 of the license, 2004
Licensed under the Apache License, Version 2.0
General Public License, version 3
Licensed under CC BY-NC 4.0
on 2024-01-31 at 10:45 the train left
the sum of 1,234,567 euros and 50 cents
page 12 of 340, section 4.2
room 101 on floor 7
it cost $19.99 or 20.00
chapter 3: the year 1848
10th of may, 5pm, 3rd row
a 4x4 car and 2 dogs
at 30%%% of 12&&& items***
from 1914 to 1918 and 1939-1945
call 911 in 2 minutes
http://example.org/a/7817 has 90 links
see https://www.example.com/2019/04/item-99.html for more
order 66 and route 128
order 9999999 was sent
order number 9999999999 is on its way
invoice 99999999 of 2019
tracking 9999999999999 shipped
192.168.1.10 and 10.0.0.1 are hosts
write to jane.doe@example.com or 45@mail2.example.com soon
~ ~ ~.99@mail9.example.com ~ ~
~ 99.199.99.19 ~ ~. ~
~ ~. 199.99.199.9 ^ ~
_!! 99.99.199.9!! _!! _!!
x = 3 + 4 * 5
y = 99 and z = 9
size = "large" and color = "blue"
name: ~ ~ and type: ~
ISBN 9799999999999 is a book
ISBN 978-9-99-999999-9 was printed
EAN 4999999999999 is on the box
isbn 9-999-99999-9 and 12345
book 9799999999999 was printed
serial 99999999 of 2010
population of 9,999,999 in 2011
the key idea is simple
the key ~ ~ ~
a password is needed here
the password ~ ~ ~ ~
enter your password below and press the button
the secret of the garden
the token was lost
the access token expired yesterday
a number is a number
his name is known
my name is on the list
call me later
ring the bell
the card is old
the account is closed
contact the office at work
New York and Los Angeles are far
the President of France spoke
Monday was cold. Then Spring came
moved to the house in May
~ ~. ^ ~ ~ ~. ^ ~, ~ ~
~ ~ ~ ~ ~ ~ ~ ~ ~
_!! _!! _!! _!!
~%%% ~&&& ~### ~ ~*** ~
| ~ | ~ ~ | ~. ~ |
^ ~ ~ ~. ^ ^ ~ ~
^ ~, ~ ~. ^ ~ ~ ~
_ _ _ _
^%%% ^&&& ~### ^. ~*** ^ ~
~### ^. ~%%% ^, ~&&& ^### ~
^. ^. ^. ~ ~. ^. ^ ^
^ ^ ^ ^ ^ ^ ^ ^ ^ ^ ^
^, ^, ^, ^, ^, ^, ^, ^,
^. ^. ^. ^. ^. ^. ^. ^.
~. ^ ^ ^ ^ ^ ^ ^ ~ ~
~. ^. ~. ^. ^ ~ ~. ^ ^. ^
~ ~ ^ ~ ~ ^ ^ ~ ^
| ^ | ^ ~ | ~. ^ | ^
^ ^ ~ ~, ^ ~ ~ ^. ^ ~.
~. ^ ~ ~. ^ ~
~ of of to ~. ^ in in of in the of
of ^ ^ to ^ ^ at ^ ^ in
is ^ is ^ ~ is ^ ^
~ 9 ~ ^ ~ 99 ~. ^
~ 999, ^ ~ ~ 99. ^ ~
99 ^ ~ and 999 ^ ~
A short line
9. ~ ~
(9) ~ ~ and (9) ~
Fig. 9.9 shows ~ ~
copyright 2019 by the authors
built in 1999, rebuilt in 2005 and 2010
it has 99999 words and 999 pages
99% of 9999 people
"""
COPIES = 6
SEEN = 5

_TRIM = "\"'`(),.;:!?<>[]{}*&%$#|="
_SYLLABLES = ["an", "the", "ri", "on", "ver", "ing", "est", "lo", "ma", "qu", "ch", "er", "eau", "tion", "heit", "ado", "po", "su", "ti", "bel", "é", "ción"]
_DRAWN = {"9": "0123456789", "A": "ABCDEFGHIJKLMNOPRSTUVWZ", "a": "abcdefghijklmnopqrstuvwxyz", "h": "0123456789abcdef", "H": "0123456789ABCDEF", "x": "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"}
LABELS = ["O", *(f"{p}-{k}" for k in CRF_KINDS for p in "BI")]
STEPS = (-2, -1, 1, 2)


def _invented(rng) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randrange(1, 5)))


def _written(form: str, rng) -> str:
    out, keep = [], False
    for c in form:
        if c == "\\" and not keep:
            keep = True
            continue
        out.append(c if keep or c not in _DRAWN and c != "~" else _invented(rng) if c == "~" else rng.choice(_DRAWN[c]))
        keep = False
    return "".join(out)


def labelled_lines(table: str, copies: int = COPIES, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """(tokens, labels) of ``copies`` writings of each line, copies of a line in a row; a span's first word is B, the next ones I."""
    rng, out = random.Random(seed), []
    for line in table.strip().splitlines():
        for _ in range(copies):
            tokens, labels = [], []
            for word in line.split():
                m = re.fullmatch(r"(.*)\{(\w+)(\+?)\}(.*)", word)
                if m:
                    parts = _written(rng.choice(FORMS[m[2] + m[3]]), rng).split()
                    parts[0], parts[-1] = m[1] + parts[0], parts[-1] + m[4]
                    tokens += parts
                    labels += [f"{'I' if i else 'B'}-{m[2]}" for i in range(len(parts))]
                else:
                    w = re.sub("~", lambda _: _invented(rng), word)
                    w = re.sub(r"\^", lambda _: _invented(rng).capitalize(), w)
                    w = re.sub("_(?![a-z])", lambda _: _invented(rng).upper(), w)
                    tokens.append(re.sub("9", lambda _: rng.choice("0123456789"), w))
                    labels.append("O")
            out.append((tokens, labels))
    return out


def shape(token: str) -> str:
    """A run of digits as 9, of capitals as A, of other letters as a; other characters stay, runs as one."""
    s = re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "9", token))
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\dA_]+", "a", s))


def _size(n: int) -> str:
    return str(n) if n < 10 else "10-12" if n < 13 else "13-14" if n < 15 else "15-16" if n < 17 else "17-19" if n < 20 else "20+"


def _word(token: str) -> str:
    return (token.strip(_TRIM) or token).lower()


def own_features(token: str) -> list[str]:
    """What a word says about its own label: its shape, sizes, changes between letters and digits, and the marks round it."""
    t = token.strip(_TRIM)
    s = shape(t)[:12]
    digits = sum(c.isascii() and c.isdigit() for c in t)
    letters = [c for c in t if c.isalpha()]
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:]))
    late = sum(c.lower() > "f" for c in letters)
    case = sum(a.islower() != b.islower() for a, b in zip(letters, letters[1:]))
    out = ["bias", f"shape={s}", f"digits={_size(digits)}", f"shape={s},digits={_size(digits)}", f"size={min(len(t) // 4, 8)}", f"switches={min(switches, 4)}", f"case={min(case, 3)}", f"first={t[:1] if not t[:1].isalnum() else ''}", f"word={_word(token)}"]
    if digits and letters:
        out.append(f"late={min(late, 3)},{min(len(t) // 8, 4)}")
    if len(t) < len(token):
        out += [f"before={token[:1] if not token[:1].isalnum() else ''}", f"after={token[-1:] if not token[-1:].isalnum() else ''}"]
    return out


def near_features(token: str) -> list[str]:
    """What a word says about the labels of the words beside it."""
    w = _word(token)
    end = token[-1:] if not token[-1:].isalnum() else ""
    return [f"shape={shape(token.strip(_TRIM) or token)[:8]}", f"word={w}", f"ends={end}", f"word={w}{end}"]


def token_features(tokens: list[str], i: int) -> list[str]:
    out = [f"0{f}" for f in own_features(tokens[i])]
    for step in STEPS:
        j = i + step
        out += [f"{step}{f}" for f in near_features(tokens[j])] if 0 <= j < len(tokens) else [f"{step}edge"]
    return out


class Crf:
    """Emission weights by feature and a transition table.

    A word's scores are a sum of a vector of its own and one of each
    neighbour, so vectors are made once for all words with the same features
    and added up in numpy. ``KNOWN`` distinct words are remembered at most.
    """

    KNOWN = 100_000

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.index, self.emit, self.step = index, emit.astype(np.float32), step.astype(np.float32)
        self._forget()

    def __getstate__(self):
        return self.index, self.emit, self.step

    def __setstate__(self, state):
        self.index, self.emit, self.step = state
        self._forget()

    def _forget(self) -> None:
        self._words = {f.partition("word=")[2] for f in self.index if "word=" in f}
        self._known: dict[bytes, int] = {}
        self._plain: dict[tuple, int] = {}
        self._used = 0
        self._rows = np.zeros((1024, 1 + len(STEPS), len(LABELS)), np.float32)

    def _sum(self, features) -> np.ndarray:
        known = [self.index[f] for f in features if f in self.index]
        return self.emit[known].sum(axis=0)

    def _row(self, word: str) -> int:
        i, self._used = self._used, self._used + 1
        if i >= len(self._rows):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        near = near_features(word)
        self._rows[i, 0] = self._sum(f"0{f}" for f in own_features(word))
        for j, step in enumerate(STEPS):
            self._rows[i, 1 + j] = self._sum(f"{step}{f}" for f in near)
        return i

    def _kind(self, word: str) -> int:
        """The row of a word's vectors. Plain words of one case, size and marks that the table does not name share theirs."""
        t = word.strip(_TRIM)
        rest = t[1:]
        if t.isalpha() and (not rest or rest.islower() or t.isascii() and t.isupper()) and t.lower() not in self._words and word.lower() not in self._words:
            key = ("A" <= t[0] <= "Z", t[0].islower(), rest[:1].islower(), bool(rest), len(t) // 4 if len(t) < 32 else 8, word[0] if word[0] != t[0] else "", word[-1] if len(word) > len(t) and not word[-1].isalnum() else "", len(word) > len(t))
            if key not in self._plain:
                self._plain[key] = self._row(word)
            return self._plain[key]
        return self._row(word)

    def _kinds(self, tokens: list[bytes]) -> np.ndarray:
        """The row of each word's vectors."""
        new = set(tokens).difference(self._known)
        if len(self._known) + len(new) > self.KNOWN:
            self._forget()
            new = set(tokens)
        for t in new:
            self._known[t] = self._kind(t.decode("utf-8", "replace"))
        return np.array(list(map(self._known.__getitem__, tokens)), np.int64)

    def scores(self, tokens: list[bytes], line: np.ndarray) -> np.ndarray:
        """(words, labels) scores; neighbours are words of the same line."""
        kind = self._kinds(tokens)
        out, n = self._rows[kind, 0], len(kind)
        for j, step in enumerate(STEPS):
            here = np.arange(n) + step
            inside = (here >= 0) & (here < n)
            inside[inside] = line[here[inside]] == line[inside]
            out[inside] += self._rows[kind[here[inside]], 1 + j]
            out[~inside] += self._sum([f"{step}edge"])
        return out

    def decode(self, e: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The likeliest labels of all lines at once by Viterbi: line i is e[first[i]:first[i + 1]].

        Lines go from long to short, so the lines that still run are always the
        first ones.
        """
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        start, size = first[:-1][order], size[order]
        longest = int(size[0]) if len(size) else 0
        running = np.searchsorted(-size, -np.arange(longest), side="left")  # lines longer than t
        k, back, path = len(LABELS), np.zeros(e.shape, np.int8), np.zeros(len(e), np.int8)
        best = e[start[: running[0]]].copy() if longest else None
        for t in range(1, longest):
            m, at = running[t], start[: running[t]] + t
            if m < 64:
                cand = best[:m, :, None] + self.step
                arg = cand.argmax(axis=1)
                top = np.take_along_axis(cand, arg[:, None], axis=1)[:, 0]
            else:
                top, arg = best[:m, :1] + self.step[0], np.zeros((m, k), np.int8)
                for p in range(1, k):
                    cand = best[:m, p: p + 1] + self.step[p]
                    more = cand > top
                    np.copyto(top, cand, where=more)
                    arg[more] = p
            back[at] = arg
            best[:m] = top + e[at]
        last = best.argmax(axis=1) if longest else None
        for t in reversed(range(longest)):
            m, at = running[t], start[: running[t]] + t
            path[at] = last[:m]
            if t:
                last[:m] = back[at, last[:m]]
        return path


def train(lines: list[tuple[list[str], list[str]]], steps: int = 150, ridge: float = 0.3) -> Crf:
    """Maximum likelihood with a ridge, by Adam on whole batches with exact gradients (forward-backward); repeatable."""
    index: dict[str, int] = {}
    often = Counter(f for ts, _ in lines for f in {f for i in range(len(ts)) for f in token_features(ts, i)})
    found = [[[index.setdefault(f, len(index)) for f in token_features(ts, i) if often[f] >= SEEN or "word=" not in f] for i in range(len(ts))] for ts, _ in lines]
    k, b, width = len(LABELS), len(lines), max(len(ts) for ts, _ in lines)
    n = np.array([len(ts) for ts, _ in lines])
    cell = np.array([i * width + t for i, fs in enumerate(found) for t, f_ in enumerate(fs) for _ in f_])
    feature = np.array([f for fs in found for f_ in fs for f in f_])
    cells, cell_at = np.unique(cell, return_index=True)
    by_feature = np.argsort(feature, kind="stable")
    feature_at = np.searchsorted(feature[by_feature], np.arange(len(index)))
    gold = np.zeros((b, width, k))
    for i, (_, ls) in enumerate(lines):
        gold[i, range(len(ls)), [LABELS.index(x) for x in ls]] = 1
    mask = np.arange(width) < n[:, None]
    w, s = np.zeros((len(index), k)), np.zeros((k, k))
    gold_steps = np.einsum("btj,btk->jk", gold[:, :-1], gold[:, 1:])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]

    def product(x, table):
        """log of exp(x) times exp(table), stable."""
        top = x.max(axis=-1, keepdims=True)
        return np.log(np.exp(x - top) @ np.exp(table) + 1e-300) + top

    for it in range(1, steps + 1):
        e = np.zeros((b * width, k))
        e[cells] = np.add.reduceat(w[feature], cell_at)
        e = e.reshape(b, width, k)
        fwd, bwd = np.zeros((b, width, k)), np.zeros((b, width, k))
        fwd[:, 0] = e[:, 0]
        for t in range(1, width):
            fwd[:, t] = np.where(mask[:, t, None], product(fwd[:, t - 1], s) + e[:, t], fwd[:, t - 1])
        for t in reversed(range(width - 1)):
            bwd[:, t] = np.where(mask[:, t + 1, None], product(e[:, t + 1] + bwd[:, t + 1], s.T), 0)
        top = fwd[:, -1].max(axis=1, keepdims=True)
        z = (np.log(np.exp(fwd[:, -1] - top).sum(axis=1, keepdims=True)) + top)[:, :, None]
        node = np.exp(fwd + bwd - z) * mask[:, :, None]
        left = fwd[:, :-1]
        right = e[:, 1:] + bwd[:, 1:] - z
        lift = left.max(axis=2, keepdims=True)
        pair = np.einsum("btj,btk->jk", np.exp(left - lift) * mask[:, 1:, None], np.exp(right + lift)) * np.exp(s)
        diff = (node - gold).reshape(-1, k)
        gw = np.add.reduceat(diff[cell[by_feature]], feature_at)
        gw, gs = gw / b + ridge * w / b, (pair - gold_steps) / b + ridge * s / b
        for at, g, x in ((0, gw, w), (2, gs, s)):
            state[at] = 0.9 * state[at] + 0.1 * g
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * g * g
            x -= 0.15 * (state[at] / (1 - 0.9**it)) / (np.sqrt(state[at + 1] / (1 - 0.99**it)) + 1e-8)
    return Crf(index, w, s)


@lru_cache(maxsize=1)
def default_model() -> Crf:
    return train(labelled_lines(LABELLED))


def spans_of(path: list[int]):
    """(kind, first, last + 1) of the labelled runs: a B or I that is not continued ends one."""
    i = 0
    while i < len(path):
        if path[i] == 0:
            i += 1
            continue
        kind, j = LABELS[path[i]][2:], i + 1
        while j < len(path) and LABELS[path[j]] == f"I-{kind}":
            j += 1
        yield kind, i, j
        i = j


def crf_spans(model: Crf, data: np.ndarray, off: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Row -> spans (kind, start, end) as byte offsets in the row; every word of every line is decoded."""
    starts, ends, first = words(data, off)
    if not len(starts):
        return {}
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    breaks = np.cumsum(data == 10)[starts]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (breaks[1:] != breaks[:-1])])
    line = np.cumsum(new) - 1
    begin = np.append(np.flatnonzero(new), len(starts))
    raw = data.tobytes()
    out: dict[int, list] = {}
    at = 0
    while at + 1 < len(begin):  # lines of about BATCH words at a time
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + BATCH, side="right")) - 1)
        a, b = int(begin[at]), int(begin[to])
        tokens = [raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())]
        path = model.decode(model.scores(tokens, line[a:b]), begin[at: to + 1] - a)
        at = to
        hot = np.flatnonzero(path)
        for r in np.unique(line[a:b][hot]).tolist():
            lo, hi = int(begin[r]), int(begin[r + 1])
            for kind, i, j in spans_of(path[lo - a: hi - a].tolist()):
                t0, t1 = (raw[starts[x]: ends[x]].decode("utf-8", "replace") for x in (lo + i, lo + j - 1))
                head = len(t0[: len(t0) - len(t0.lstrip(_TRIM.replace("(", "")))].encode())
                tail = len(t1[len(t1.rstrip(_TRIM)):].encode())
                s, e = int(starts[lo + i]) + head, int(ends[lo + j - 1]) - tail
                mark = raw[s:e].find(b'="')  # KEY="..." is one word
                s += mark + 2 if mark >= 0 else 0
                if s < e:
                    own = int(row[lo])
                    out.setdefault(own, []).append((kind, s - int(off[own]), e - int(off[own])))
    return out


_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64]] = True


def find(data: np.ndarray, off: np.ndarray, model: Crf) -> list[tuple[str, list, list]]:
    """Per row with spans: (row, base spans, all spans) in code points; every base pattern needs a digit or an @."""
    added = crf_spans(model, data, off)
    seen = np.concatenate([[0], np.cumsum(_TRIGGER[data])])
    some = seen[off[1:]] > seen[off[:-1]]
    some[list(added)] = True
    raw, out = data.tobytes(), []
    for i in np.flatnonzero(some).tolist():
        text = raw[off[i]: off[i + 1]].decode("utf-8", "replace")
        base = base_spans(text)
        extra = []
        if i in added:
            wide = np.concatenate([[0], np.cumsum((data[off[i]: off[i + 1]] & 0xC0) != 0x80)])
            taken = sorted((a, b) for _, a, b in base)
            begins = [a for a, _ in taken]
            for kind, a, b in added[i]:
                a, b = int(wide[a]), int(wide[b])
                near = taken[max(0, bisect_left(begins, a) - 4): bisect_left(begins, b)]  # base spans of four kinds, each free of overlaps
                if not any(x < b and a < y for x, y in near):
                    extra.append((kind, a, b))
        both = sorted(base + extra, key=lambda s: (_KINDS.index(s[0]), s[1], s[2]))
        if both:
            out.append((i, base, both))
    return out


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_NOTHING = hashlib.sha256(b"").hexdigest()


def detect(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """Per document: doc_id, the base counts, base_sha256, spans and n_spans."""
    prepare(docs.sparkSession)
    model = model or default_model()

    def run(batches):
        import pyarrow as pa

        for rows, data, off in slices(batches, "text"):
            n = len(off) - 1
            counts, digest, spans, found = np.zeros((4, n), np.int64), [_NOTHING] * n, [""] * n, np.zeros(n, np.int64)
            for i, base, both in find(data, off, model):
                for k, _, _ in base:
                    counts[BASE_KINDS.index(k), i] += 1
                digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i], found[i] = joined(both), len(both)
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, counts), pa.array(digest), pa.array(spans), pa.array(found)], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans"])

    longs = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {longs}, base_sha256 string, spans string, n_spans long")


def masked_text(text: str, spans) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap are masked as one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """``docs`` with personal data masked in ``text``, and ``n_chars``, where there is one, recounted; other columns as they are."""
    prepare(docs.sparkSession)
    model = model or default_model()

    def run(batches):
        import pyarrow as pa

        for rows, data, off in slices(batches, "text"):
            at = rows.schema.get_field_index("text")
            texts = rows.column(at).to_pylist()
            for i, _, both in find(data, off, model):
                texts[i] = masked_text(texts[i], both)
            yield rows.set_column(at, rows.schema.field(at), pa.array(texts, rows.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_pii(spark, sf_dir):
    return detect(documents(spark, sf_dir))
