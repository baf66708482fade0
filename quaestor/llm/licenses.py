"""License scans: ordered signature rules, keyword gates, suppression by interval.

Texts are read as words: runs of digits, letters `a-z` after lower-casing `A-Z`,
and every character beyond ASCII. Signatures are expressions over the words
joined by single blanks. Each names the keywords that its matches contain; a
document's words are looked up among all keywords, by hash and for a block of
documents at once, and only rules whose keywords a document holds run on it.

There are two kinds. Named forms are six ways of stating a license times the
names of 62; the signatures of `license_texts`, written one by one, know
passages of the texts themselves, file headers and addresses, so that a license
needs no name to be found.

Detections are taken by priority (identifiers, then passages, notices, names and
addresses), the longer and the earlier first, and one that lies inside an
interval already taken is suppressed. All of it takes time in proportion to a
text and its detections. The base phrases are found apart, at every place where
their words stand in a row, and their labels always stay.

The score is that of the surest detection left, 0 without any. Null and empty
texts have no words. Repeated rows are scanned each; null ids are carried. An
empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.license_texts import BODIES, GAP_WORDS, LINKS
from quaestor.llm.textops import LOWER, Block, hash_runs, map_blocks

#: The base phrases and their labels.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
BASE_SCORE = 0.8

_VERSION = r"(?: (?:version |v)?\d+(?: \d+)*)?"
_LICENSE = r"(?: licen[sc]e)?"

#: Label, expression of the name, a keyword of every match of it, words of its identifier.
FAMILIES = (
    ("mit", r"mit", "mit", r"mit"),
    ("mit", r"expat", "expat", r"expat"),
    ("mit-0", r"mit no attribution", "attribution", r"mit 0"),
    ("apache", r"apache(?: software)?", "apache", r"apache \d \d"),
    ("bsd-2-clause", r"(?:simplified|freebsd|(?:2|two) clause) bsd", "bsd", r"bsd 2 clause"),
    ("bsd-3-clause", r"(?:new|modified|revised|(?:3|three) clause) bsd", "bsd", r"bsd 3 clause"),
    ("bsd-4-clause", r"(?:original|(?:4|four) clause) bsd", "bsd", r"bsd 4 clause"),
    ("bsd", r"bsd(?: style)?", "bsd", r"bsd"),
    ("0bsd", r"(?:zero clause|free public license) bsd", "bsd", r"0bsd"),
    ("gpl", r"(?:gnu )?(?:gpl|general public)", "gnu", r"gpl \d(?: \d)?(?: only| or later)?"),
    ("gpl", r"gplv?[1-3](?: \d)?", "gplv", r"gplv?[1-3]"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) (?:gpl|general public)", "general", r"lgpl \d(?: \d)?(?: only| or later)?"),
    ("lgpl", r"(?:gnu )?lgpl", "lgpl", r"lgplv?\d"),
    ("agpl", r"(?:gnu )?affero (?:gpl|general public)", "affero", r"agpl \d(?: \d)?(?: only| or later)?"),
    ("agpl", r"(?:gnu )?agpl", "agpl", r"agplv?\d"),
    ("gfdl", r"gnu free documentation", "documentation", r"gfdl \d \d(?: only| or later)?"),
    ("mpl", r"mozilla public", "mozilla", r"mpl \d \d"),
    ("epl", r"eclipse public", "eclipse", r"epl \d \d"),
    ("cpl", r"common public", "common", r"cpl \d \d"),
    ("ipl", r"ibm public", "ibm", r"ipl \d \d"),
    ("cddl", r"common development and distribution", "distribution", r"cddl \d \d"),
    ("eupl", r"european union public", "european", r"eupl \d \d"),
    ("osl", r"open software", "open", r"osl \d \d"),
    ("afl", r"academic free", "academic", r"afl \d \d"),
    ("artistic", r"(?:perl )?artistic", "artistic", r"artistic \d \d"),
    ("isc", r"isc", "isc", r"isc"),
    ("zlib", r"zlib(?: libpng)?", "zlib", r"zlib"),
    ("libpng", r"libpng", "libpng", r"libpng \d \d"),
    ("boost", r"boost(?: software)?", "boost", r"bsl \d \d"),
    ("unlicense", r"unlicense", "unlicense", r"unlicense"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "public", r"wtfpl"),
    ("beerware", r"beer ?ware", "beerware", r"beerware"),
    ("postgresql", r"postgresql", "postgresql", r"postgresql"),
    ("python", r"python(?: software foundation)?", "python", r"(?:psf|python) \d(?: \d)?"),
    ("php", r"php", "php", r"php \d \d\d?"),
    ("ruby", r"ruby", "ruby", r"ruby"),
    ("openssl", r"openssl", "openssl", r"openssl"),
    ("curl", r"curl", "curl", r"curl"),
    ("w3c", r"w3c(?: software notice and)?", "w3c", r"w3c(?: \d+)?"),
    ("x11", r"x11", "x11", r"x11"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa", r"ncsa"),
    ("ofl", r"(?:sil )?open font", "font", r"ofl \d \d"),
    ("ms-pl", r"microsoft public", "microsoft", r"ms pl"),
    ("ms-rl", r"microsoft reciprocal", "microsoft", r"ms rl"),
    ("zpl", r"zope public", "zope", r"zpl \d \d"),
    ("lppl", r"latex project public", "latex", r"lppl \d \d\w?"),
    ("bsl", r"business source", "business", r"busl \d \d"),
    ("sspl", r"server side public", "server", r"sspl \d \d"),
    ("elastic", r"elastic", "elastic", r"elastic \d \d"),
    ("mulan", r"mulan (?:psl|permissive software)", "mulan", r"mulanpsl \d \d"),
    ("upl", r"universal permissive", "universal", r"upl \d \d"),
    ("cecill", r"cecill", "cecill", r"cecill \d \d"),
    ("odbl", r"open (?:database|data commons)", "open", r"odbl \d \d"),
    ("cc0", r"(?:cc0|creative commons zero)", "cc0", r"cc0 \d \d"),
    ("cc-by", r"(?:cc by|creative commons attribution)", "by", r"cc by \d \d"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "by", r"cc by sa \d \d"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", "by", r"cc by nc \d \d"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv\w*)", "by", r"cc by nd \d \d"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "by", r"cc by nc sa \d \d"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w*)", "by", r"cc by nc nd \d \d"),
    ("public-domain", r"public domain", "domain", r"public domain"),
    ("proprietary", r"(?:proprietary|commercial|end user)", "proprietary", r"licenseref proprietary"),
)

#: Forms in which a license is stated, by priority: expression around the name
#: `{n}` or identifier `{i}`, keywords, score.
FORMS = (
    (r"spdx license identifier {i}", ("spdx",), 1.0),
    (r"licen[sc]ed under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{n}" + _LICENSE + _VERSION, ("licensed",), 0.95),
    (
        r"(?:released|distributed|available|provided|published|offered) under (?:the )?(?:terms of )?(?:the )?{n}"
        + _LICENSE
        + _VERSION,
        ("under",),
        0.9,
    ),
    (r"subject to (?:the )?(?:terms of )?(?:the )?{n} licen[sc]e" + _VERSION, ("subject",), 0.85),
    (r"{n} licen[sc]e" + _VERSION, ("license",), 0.8),
    (r"licen[sc]e {i}", ("license",), 0.7),
)

@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    score: float
    priority: int  # the smallest is taken first


BODY_SCORE, LINK_SCORE = 0.95, 0.75
_BODY_PRIORITY = 1


def _compiled(text: str) -> re.Pattern:
    # The blank in front, which each word has, lets most places fail at once.
    return re.compile(rf" {text}(?![^ ])")


@lru_cache(maxsize=1)
def signature_rules() -> tuple[Rule, ...]:
    """All families in all forms, the first form first."""
    rules = []
    for priority, (form, keywords, score) in enumerate(FORMS):
        for label, name, keyword, identifier in FAMILIES:
            text = form.format(n=f"(?:{name})", i=f"(?:{identifier})")
            # The identifier doesn't hold the name's keyword.
            needs = keywords if "{i}" in form else (*keywords, keyword)
            priority_ = priority + (priority >= _BODY_PRIORITY)
            rules.append(Rule(label, _compiled(text), needs, score, priority_))
    return tuple(rules)


@lru_cache(maxsize=1)
def written_rules() -> tuple[Rule, ...]:
    """The signatures of passages and addresses."""
    gap = f"(?: [^ ]+){{0,{GAP_WORDS}}}? "
    kinds = ((BODIES, BODY_SCORE, _BODY_PRIORITY), (LINKS, LINK_SCORE, len(FORMS) + 1))
    return tuple(
        Rule(label, _compiled(text.replace(" ... ", gap)), keywords, score, priority)
        for table, score, priority in kinds
        for label, text, keywords in table
    )


#: Two-name families whose names share no word: any of these is the keyword.
_ALTERNATIVES = {
    "by": ("by", "commons"),
    "gnu": ("gnu", "gpl", "general"),
    "general": ("general", "lesser", "library"),
    "gplv": ("gplv1", "gplv2", "gplv3", "gpl1", "gpl2", "gpl3"),
    "cc0": ("cc0", "commons"),
    "public": ("public", "wtfpl"),
    "beerware": ("beerware", "beer"),
    "proprietary": ("proprietary", "commercial", "end"),
    "license": ("license", "licence"),
    "licensed": ("licensed", "licenced"),
    "copyleft": ("copyleft", "lgpl", "lesser"),
}

WORD = np.ones(256, bool)
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False

_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return hash_runs(data, np.array([0]), np.array([len(data)]))[0]


class Scanner:
    def __init__(self):
        self.rules = signature_rules()
        self.every = (*written_rules(), *self.rules)
        named = sorted({k for r in self.every for k in r.keywords})
        spelled = [(w, i) for i, k in enumerate(named) for w in _ALTERNATIVES.get(k, (k,))]
        hashes = np.array([_word_hash(w) for w, _ in spelled], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        keyword = np.array([i for _, i in spelled])[order]
        # A word may stand for several keywords: one bit each.
        self.bits = {}
        for h, k in zip(self.hashes.tolist(), keyword.tolist()):
            self.bits[h] = self.bits.get(h, 0) | 1 << k
        self.unique = np.array(sorted(self.bits), np.uint64)
        # Most words fail here, by 16 bits of their hash.
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.unique & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.needs = [sum(1 << named.index(k) for k in set(r.keywords)) for r in self.every]
        self.phrases = [[_word_hash(w) for w in p.split()] for p, _ in BASE_PHRASES]

    def keywords(self, hashes: np.ndarray, document: np.ndarray, n: int) -> list[int]:
        """The keywords of each document, a bit each."""
        held = [0] * n
        maybe = np.flatnonzero(self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        pairs = {(d, h) for d, h in zip(document[maybe].tolist(), hashes[maybe].tolist())}
        for d, h in pairs:
            held[d] |= self.bits.get(h, 0)
        return held

    @lru_cache(maxsize=100_000)
    def fetched(self, held: int) -> tuple[int, ...]:
        """The rules whose keywords are all held."""
        return tuple(i for i, needs in enumerate(self.needs) if held & needs == needs)

    def base(self, hashes: np.ndarray, document: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each base phrase, the places and documents where it begins."""
        out = []
        for phrase in self.phrases:
            n = len(hashes) - len(phrase) + 1
            if n <= 0:
                out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
                continue
            here = document[:n] == document[len(phrase) - 1 :]
            for j, word in enumerate(phrase):
                here &= hashes[j : j + n] == word
            at = np.flatnonzero(here)
            out.append((at, document[at]))
        return out

    def detect(self, text: bytes, held: int) -> list[tuple[int, int, str, float]]:
        """(first word, end, label, score) of the detections that stay."""
        fetched = self.fetched(held)
        if not fetched:
            return []
        joined = b" ".join([b"", *_WORDS.findall(text)]).decode("utf-8", "replace")
        blanks, found = None, []
        for order in fetched:
            rule = self.every[order]
            spans = [match.span() for match in rule.pattern.finditer(joined)]
            if not spans:
                continue
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
            for start, end in np.searchsorted(blanks, spans).tolist():
                found.append((rule.priority, start - end, start, order, end, rule))
        covered = Intervals()
        taken: list[tuple[int, int, str, float]] = []
        for _, _, start, _, end, rule in sorted(found, key=lambda f: f[:4]):
            if covered.add(start, end):
                taken.append((start, end, rule.label, rule.score))
        return sorted(taken)


class Intervals:
    """Those that lie in no other, by their starts, so that their ends ascend too."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Add an interval; false if it lies inside one that is there."""
        after = bisect_right(self.starts, start)
        if after and self.ends[after - 1] >= end:
            return False
        first = after - 1 if after and self.starts[after - 1] == start else after
        last = bisect_right(self.ends, end)
        self.starts[first : max(first, last)] = [start]
        self.ends[first : max(first, last)] = [end]
        return True


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def make(batch: pa.RecordBatch, block: Block) -> pa.RecordBatch:
        scan, n = scanner(), len(block)
        data = LOWER[block.data]
        starts, ends, document = block.runs(WORD[data])
        hashes = hash_runs(data, starts, ends)
        counts = np.bincount(document, minlength=n)
        begin = np.cumsum(counts) - counts
        places: list[list[int]] = [[] for _ in range(n)]
        base: list[set[str]] = [set() for _ in range(n)]
        for (at, where), (_, label) in zip(scan.base(hashes, document), BASE_PHRASES):
            for a, d in zip(at.tolist(), where.tolist()):
                places[d].append(a - int(begin[d]))
                base[d].add(label)
        found: list[list] = [[] for _ in range(n)]
        for d, held in enumerate(scan.keywords(hashes, document, n)):
            if held:
                found[d] = scan.detect(data[block.offsets[d] : block.offsets[d + 1]].tobytes(), held)
        every = [b | {f[2] for f in own_found} for b, own_found in zip(base, found)]
        scores = [
            max([*(f[3] for f in own_found), BASE_SCORE if b else 0.0]) for b, own_found in zip(base, found)
        ]
        columns = [
            batch.column(0)[block.rows],
            pa.array(counts, pa.int64()),
            pa.array([len(p) for p in places], pa.int64()),
            pa.array([min(p, default=None) for p in places], pa.int64()),
            pa.array([max(p, default=None) for p in places], pa.int64()),
            pa.array([",".join(sorted(b)) for b in base]),
            pa.array([",".join(sorted(e)) for e in every]),
            pa.array(scores, pa.float64()),
            pa.array([",".join(f"{f[2]}:{f[0]}:{f[1]}" for f in own_found) for own_found in found]),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    schema = (
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double, detections string"
    )
    return own.mapInArrow(lambda batches: map_blocks(batches, 1, make), schema)
