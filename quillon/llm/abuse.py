"""Scores of abusive, hateful and sexually explicit language.

Texts are read as words in a plain form (no case, accents, invisible characters, look-alike letters,
digits or signs for letters, stretched letters, or spaces between letters). Words are looked up in a trie of all lexicon words
with Levenshtein automata, so that misspelled words are found. Phrases and insults give a window of
words a score, which signs of mere mention in the same sentence take away.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import lexicon
from quillon.plans.durable import spread

#: Words around a hit in which an address, and other hits, count; a mention counts in the same sentence,
#: ``AROUND`` words before the hit or ``NEAR`` after it.
NEAR, AROUND = 5, 14
_ACCENTS = {ord("ß"): "ss", ord("æ"): "ae", ord("œ"): "oe", ord("ø"): "o", ord("ł"): "l", ord("ı"): "i"}
#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнɡνοαερτυικ", "aeopcyxijsdhkmtbhgvoaeptuik")
_LEET = str.maketrans("4301578@$!", "aeoistbasi")
#: Letters hidden behind signs; each sign stands for one letter.
_MASKED = re.compile(r"[a-z](?=[a-z]*[#*%&@$]{2})[a-z#*%&@$]{2,}[a-z]|[a-z]+[#*][a-z]+")
_WORD = re.compile(_MASKED.pattern + r"|[^\W_]+(?:['’ʼ`@$!][^\W_]+)*|[@$][^\W_]+|[4]")
#: Ends of sentences; not the points between letters that stand alone.
_END = re.compile(r"[?\n]|!(?![^\W\d_])|\.(?![^\W_](?:[\W_]|$))")
#: Three or more letters that stand alone one after the other.
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_](?![^\W_])){2}")
#: Marks on letters, and invisible characters.
_DROPPED = re.compile("[" + "".join(re.escape(chr(i)) for i in range(128, 0x10000) if unicodedata.combining(chr(i)) or unicodedata.category(chr(i)) == "Cf") + "]+")
_FOREIGN = re.compile(r"\w*[^\x00-\x7f\W]\w*")
_LONG = re.compile(r"(.)\1{2,}")
_LATIN = re.compile(r"[a-z]")


class LevenshteinTrie:
    """The words of a lexicon; ``match`` gives those within the distance a word's length allows.

    Words of five letters or more may be one edit (a letter more, less, other, or two changed about)
    away. The automaton of that distance has two states, with and without an edit behind it; it is
    run along the trie and left where no branch goes on.
    """

    def __init__(self, words: set[str]):
        self.root: dict = {}
        self.longest = max(map(len, words), default=0)
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.known: dict[str, frozenset[str]] = {}

    @staticmethod
    def bound(word: str) -> int:
        return 0 if len(word) < 5 else 1

    def near(self, word: str) -> frozenset[str]:
        """The words one edit from a written word of three or four letters that is in no list itself."""
        if not 3 <= len(word) <= 4 or not word.isalpha() or word in lexicon.COMMON or self.match(word):
            return frozenset()
        return frozenset(self._one_edit(word))

    def match(self, word: str) -> frozenset[str]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found = frozenset(self._walk(word))
        return found

    def _masked(self, word: str) -> set[str]:
        nodes = [self.root]
        for c in word:
            nodes = [x for node in nodes for k, x in node.items() if k and (k == c or not c.isalnum())]
        return {node[""] for node in nodes if "" in node}

    def _walk(self, word: str) -> set[str]:
        if not word.isalnum():
            return self._masked(word)
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                break
        if node is not None and "" in node:
            return {node[""]}
        return self._one_edit(word) if self.bound(word) and len(word) <= self.longest + 1 else set()

    def _one_edit(self, word: str) -> set[str]:
        """The automaton's walk: in its first state along the word, in its second, after one edit, to the end."""
        out: set[str] = set()
        node, n = self.root, len(word)
        for i in range(n + 1):
            if i < n:
                self._finish(node, word, i + 1, out)
            for c, child in node.items():
                if c:
                    self._finish(child, word, i, out)
                    if i < n and c != word[i]:
                        self._finish(child, word, i + 1, out)
            if i + 1 < n and (a := node.get(word[i + 1])) and (b := a.get(word[i])):
                self._finish(b, word, i + 2, out)
            node = node.get(word[i]) if i < n else None
            if node is None:
                break
        return out

    @staticmethod
    def _finish(node: dict, word: str, i: int, out: set[str]) -> None:
        for c in word[i:]:
            node = node.get(c)
            if node is None:
                return
        if "" in node and len(node[""]) >= 4:
            out.add(node[""])


def plain(text: str) -> str:
    """Lower case without accents, invisible characters and look-alike letters."""
    if text.isascii():
        return text.lower()
    t = _DROPPED.sub("", unicodedata.normalize("NFKD", text).casefold().translate(_ACCENTS))
    return _FOREIGN.sub(lambda m: m[0].translate(_LOOKALIKES) if _LATIN.search(m[0]) or len(m[0]) == 1 else m[0], t)


def _joined(part: str) -> list[str]:
    """The words of a sentence in which letters stand alone, a run of them as one word."""
    at = [m.span() for m in _WORD.finditer(part)]
    raw = [part[a:b] for a, b in at]
    out: list[str] = []
    i = 0
    while i < len(raw):
        if len(raw[i]) == 1 and i + 2 < len(raw) and len(raw[i + 1]) == 1 and len(raw[i + 2]) == 1:
            # A wider gap than between the first two letters ends a word.
            j, gap = i + 1, at[i + 1][0] - at[i][1]
            while j < len(raw) and len(raw[j]) == 1 and at[j][0] - at[j - 1][1] <= gap:
                j += 1
            out.append("".join(raw[i:j]))
            i = j
        else:
            out.append(raw[i])
            i += 1
    return out


def words(text: str) -> tuple[list[str], list[int]]:
    """The words of a text in its plain form, letters set apart by spaces as one, and their sentences' numbers."""
    out: list[str] = []
    sentences: list[int] = []
    for k, part in enumerate(_END.split(plain(text))):
        found = _joined(part) if _SPACED.search(part) else _WORD.findall(part)
        out += found
        sentences += [k] * len(found)
    return out, sentences


def unleet(word: str) -> str:
    """A word with signs and digits read as letters and stretched letters shortened; masked words stay."""
    if not word.isalpha() and not _MASKED.fullmatch(word):
        if any(c.isalpha() for c in word) or word == "4":
            word = word.translate(_LEET)
        word = re.sub(r"['’ʼ`@$!]", "", word)
    return _LONG.sub(r"\1", word)


@dataclass(frozen=True)
class Phrase:
    parts: tuple[frozenset[str], ...]
    category: str


class Scorer:
    """The lexicon made ready; what a word stands for is kept, so that a word costs a look-up from then on."""

    def __init__(self) -> None:
        lists = (("person", lexicon.PERSON), ("group", lexicon.GROUP), ("sexual", lexicon.SEXUAL), ("mention", [m for m in lexicon.MENTIONS if m not in lexicon.WEAK]), ("weak", [m for m in lexicon.MENTIONS if m in lexicon.WEAK]))
        phrases = [Phrase(tuple(frozenset(p.split("|")) for p in line.split()), c) for c, lines in lists for line in lines]
        self.first: dict[str, list[Phrase]] = {}
        for p in phrases:
            for w in p.parts[0]:
                self.first.setdefault(w, []).append(p)
        self.insults, self.address = frozenset(lexicon.INSULTS), frozenset(lexicon.ADDRESS)
        self.roles: dict[str, frozenset[str]] = {}
        for role, listed in lexicon.ROLES.items():
            for w in listed.split():
                self.roles[w] = self.roles.get(w, frozenset()) | {role}
        self.anchors = frozenset(first for _, first, _ in lexicon.RULES)
        self.seen: dict[str, frozenset[str]] = {}
        self.loose: dict[str, frozenset[str]] = {}
        self.trie = LevenshteinTrie({w for p in phrases for s in p.parts for w in s} | self.insults | self.address | set(self.roles))

    def _lexical(self, raw: str) -> frozenset[str]:
        word = unleet(raw)
        found = self.trie.match(word)
        if not found and len(word) > 4 and word[0] in "aiu":
            found = self.trie.match(word[1:]) if word[1:] in self.insults else found
        if len(self.seen) > 500_000:
            self.seen.clear()
        self.seen[raw] = found
        return found

    def _near(self, raw: str) -> frozenset[str]:
        found = self.loose.get(raw)
        if found is None:
            if len(self.loose) > 500_000:
                self.loose.clear()
            self.loose[raw] = found = self.trie.near(unleet(raw))
        return found

    @staticmethod
    def _predicate(found_words: list[str], sentence: list[int], i: int) -> bool:
        """Whether word ``i`` is what a name or group is said to be: ``X is a ...``, ``the X are ...``."""
        j = i - 1
        while j >= max(0, i - 4) and found_words[j] in lexicon.FILLERS:
            j -= 1
        return j > 0 and found_words[j] in lexicon.PREDICATES and sentence[j - 1] == sentence[i] and found_words[j - 1] not in lexicon.NO_PERSON

    def score(self, text: str | None) -> tuple[float, str | None]:
        """(score, category): 1 or more for a text with abuse; the score of its worst window."""
        if not text:
            return 0.0, None
        found_words, sentence = words(text)
        seen = self.seen.get
        hits = [h if (h := seen(w)) is not None else self._lexical(w) for w in found_words]
        if not any(hits):
            return 0.0, None
        # Short words may be one edit away, but as one word of a phrase only.
        loose = [self._near(w) if not h and 3 <= len(w) <= 4 else frozenset() for w, h in zip(found_words, hits)]
        found: list[tuple[int, float, str, bool]] = []
        mentions: list[tuple[int, bool]] = []
        for i, h in enumerate(hits):
            if not h and not loose[i]:
                continue
            for w in h or loose[i]:
                for p in self.first.get(w, ()):
                    mention = p.category in ("mention", "weak")
                    if self._follow(hits, i, p) is None and (mention or len(p.parts) < 2 or not self._loosely(hits, loose, i, p)):
                        continue
                    if not h and (mention or len(p.parts) < 2):
                        continue
                    if mention:
                        mentions.append((i, p.category == "weak"))
                    else:
                        found.append((i, 1.0, p.category, True))
            if insults := h & self.insults:
                beside = sum(bool(x & self.address) for x in hits[max(0, i - NEAR) : i + NEAR + 1])
                said = bool(insults - lexicon.SENSES) and self._predicate(found_words, sentence, i)
                found.append((i, 0.5 + 0.5 * min(beside + said, 2), "person", False))
        found += self._by_roles(hits, sentence)
        best, kind = 0.0, None
        for i, weight, category, phrase in found:
            total = weight + 0.25 * sum(1 for j, *_ in found if j != i and abs(j - i) <= AROUND)
            if any(sentence[m] == sentence[i] and -AROUND <= m - i <= NEAR and not (weak and phrase) for m, weak in mentions):
                total *= 0.3
            if total > best:
                best, kind = total, category
        return best, kind

    def _by_roles(self, hits: list[frozenset[str]], sentence: list[int]) -> list[tuple[int, float, str, bool]]:
        """A hit for every word with the first role of a rule that has the others about it in its sentence."""
        roles = {i: r for i, h in enumerate(hits) if h and (r := frozenset().union(*[self.roles.get(w, ()) for w in h]))}
        out = []
        for i, own in roles.items():
            if own & self.anchors:
                for category, first, rest in lexicon.RULES:
                    if first in own and self._filled(rest, i, roles, sentence, ()):
                        out.append((i, 1.0, category, True))
                        break
        return out

    @classmethod
    def _filled(cls, rest: tuple, i: int, roles: dict[int, frozenset[str]], sentence: list[int], taken: tuple[int, ...]) -> bool:
        """Whether every role left has a word of its own in its place about word ``i``."""
        if not rest:
            return True
        role, low, high = rest[0]
        some = (j for j in range(i + low, i + high + 1) if j != i and j not in taken and j in roles and role in roles[j] and sentence[j] == sentence[i])
        return any(cls._filled(rest[1:], i, roles, sentence, (*taken, j)) for j in some)

    @staticmethod
    def _loosely(hits: list[frozenset[str]], loose: list[frozenset[str]], i: int, p: Phrase) -> bool:
        """Whether the phrase starts at ``i`` with one of its words a short one that is an edit away."""
        misspelled = not hits[i]
        for part in p.parts[1:]:
            for j in range(i + 1, min(i + 2 + lexicon.GAP, len(hits))):
                if hits[j] & part:
                    break
                if not misspelled and loose[j] & part:
                    misspelled = True
                    break
            else:
                return False
            i = j
        return True

    @staticmethod
    def _follow(hits: list[frozenset[str]], i: int, p: Phrase) -> int | None:
        for part in p.parts[1:]:
            for j in range(i + 1, min(i + 2 + lexicon.GAP, len(hits))):
                if hits[j] & part:
                    i = j
                    break
            else:
                return None
        return i


@lru_cache(maxsize=1)
def _scorer() -> Scorer:
    """One a worker process, which goes through many tasks."""
    return Scorer()


def abuse_scores(df: DataFrame, record: str, text: str) -> DataFrame:
    """``record``, score, category (person, group, sexual; null without a hit) of each row's text.

    1 or more marks abuse. Null, empty and blank texts have the score 0. Whole texts are read,
    whatever their length; repeated rows come out repeated. Other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer()
        for pdf in batches:
            found = [scorer.score(t if isinstance(t, str) else None) for t in pdf["_text"]]
            yield pd.DataFrame({record: pdf[record], "score": [s for s, _ in found], "category": pd.Series([c for _, c in found], dtype=object)})

    kind = dict(df.dtypes)[record]
    return spread(df.select(record, F.col(text).cast("string").alias("_text")), record).mapInPandas(run, f"`{record}` {kind}, score double, category string")


def abuse_rates(scored: DataFrame, source: str) -> DataFrame:
    """``source``, n_documents, n_abusive, rate and mean_score; documents without a source are one row with null."""
    abusive = F.col("score") >= 1
    return scored.groupBy(source).agg(F.count("*").alias("n_documents"), F.count_if(abusive).alias("n_abusive"), F.avg(abusive.cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
