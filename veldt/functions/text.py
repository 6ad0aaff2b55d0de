"""Text functions as columns where built-in functions can say them, as Arrow functions where not."""

from __future__ import annotations

import bisect
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

#: White space of Unicode as Python's str.split() has it, and the four separators from U+001C on.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def collapse(text: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by a bar, as lowercase hex; null parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


# fixed values: what is scrubbed, in this order: kind, note, pattern
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
SCRUB = (
    ("name", "[name removed]", r"\b(?i:mrs|mr|dr|rev)\.?\s+[\p{L}'-]+(?:\s+[A-Z][\p{L}'-]*)?"),
    ("name", "[name removed]", r"\b(?:Ms|Miss|Master)\.?\s+[A-Z][\p{L}'-]*(?:\s+[A-Z][\p{L}'-]*)?"),
    ("name", "[name removed]", r"[\x{D80}-\x{DFF}]+\s+(?:මහත්මිය|මහතා|මෙනවිය)"),
    ("name", "[name removed]", r"(?<![\x{B80}-\x{BFF}])(?:திருமதி|திரு|செல்வி)\s+[\x{B80}-\x{BFF}]+"),
    ("identifier", "[ID removed]", r"\b(?:MRN|BHT|NIC|ID|Reg(?:istration)?\s*No|Clinic\s*No)\.?\s*[:#]?\s*(?=[A-Za-z0-9/-]*\d)[A-Za-z0-9/-]{3,}"),
    ("identifier", "[ID removed]", r"\b(?:\d{9}[VvXx]|(?:19|20)\d{10})\b"),
    ("email", "[email removed]", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    ("date", "[date removed]", r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"),
    ("date", "[date removed]", r"\b\d{4}-\d{1,2}-\d{1,2}\b"),
    ("date", "[date removed]", rf"\b\d{{1,2}}\s+{_MONTH},?\s+\d{{4}}\b"),
    ("date", "[date removed]", rf"\b{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b"),
    ("number", "[number removed]", r"(?<![\w.])\+?\d(?:[\s-]?\d){6,}(?![\w.])"),
)

#: The same matches in time linear in the text: an address starts only where a run of its letters does or the last one ended, and
#: a run of blanks is read once.
LINEAR = {
    r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+": r"(?:(?<![\w.+-])|\G)[\w.+-]++@[\w-]+(?:\.[\w-]+)+",
    r"\b(?:MRN|BHT|NIC|ID|Reg(?:istration)?\s*No|Clinic\s*No)\.?\s*[:#]?\s*(?=[A-Za-z0-9/-]*\d)[A-Za-z0-9/-]{3,}": (
        r"\b(?:MRN|BHT|NIC|ID|Reg(?:istration)?\s*+No|Clinic\s*+No)\.?\s*+(?:[:#]\s*+)?(?=[A-Za-z/-]*+\d)[A-Za-z0-9/-]{3,}"
    ),
}


def scrub(text: Column, rules=SCRUB) -> tuple[Column, Column]:
    """(text without personal details, kinds removed in the order of the rules, each once).

    The text goes from rule to rule as the variable of a lambda, so that no replacement is computed twice.
    """
    def replaced(pattern: str, note: str):
        return lambda s: F.struct(F.regexp_replace(s["t"], LINEAR.get(pattern, pattern), note).alias("a"), s["t"].alias("t"), s["k"].alias("k"))

    def noted(kind: str):
        return lambda s: F.struct(s["a"].alias("t"), F.when(s["a"] != s["t"], F.array_append(s["k"], F.lit(kind))).otherwise(s["k"]).alias("k"))

    state = F.array(F.struct(text.alias("t"), F.array().cast("array<string>").alias("k")))
    for kind, note, pattern in rules:
        state = F.transform(F.transform(state, replaced(pattern, note)), noted(kind))
    return state[0]["t"], F.array_distinct(state[0]["k"])


def script_counts(text: Column) -> dict[str, Column]:
    """Letters of a few scripts in a text."""
    count = lambda s: (F.length(text) - F.length(F.regexp_replace(text, s, ""))).cast("long")
    return {
        "latin": count(r"[A-Za-z\x{C0}-\x{24F}]"),
        "sinhala": count(r"[\x{D80}-\x{DFF}]"),
        "tamil": count(r"[\x{B80}-\x{BFF}]"),
        "cyrillic": count(r"[\x{400}-\x{4FF}]"),
    }


def majority_script(text: Column) -> Column:
    """The script with most letters, the first in case of a tie; null without any."""
    counts = script_counts(text)
    best = F.greatest(*counts.values())
    out = F.when(F.coalesce(best, F.lit(0)) == 0, F.lit(None).cast("string"))
    for name, c in counts.items():
        out = out.when(c == best, name)
    return out


TAG = r"\[([^\[\]]*)\]"


def tag_problem(statement: Column, issued: Column) -> Column:
    """The first problem of a statement's citation tags such as [S1], or null.

    ``malformed``: a bracket that looks like a tag and isn't one; ``not issued``: a tag outside ``issued``; ``no tag at the end``.
    """
    inside = F.filter(F.regexp_extract_all(statement, F.lit(TAG)), lambda x: x.rlike(r"(?i)\bS\s*\d"))
    bad = F.transform(
        inside,
        lambda x: F.when(~x.rlike("^S[1-9][0-9]*$"), F.concat(F.lit("malformed ["), x, F.lit("]"))).when(
            ~F.array_contains(issued, x), F.concat(F.lit("not issued ["), x, F.lit("]"))
        ),
    )
    first = F.try_element_at(F.array_compact(bad), F.lit(1))
    return F.coalesce(first, F.when(~statement.rlike(r"\[S[1-9][0-9]*\]\s*$"), F.lit("no tag at the end")))


# fixed values: where a sentence ends: before a bullet, behind a full stop and closing marks, behind a stop with reference numbers
BULLET = r"(?<=\S)(?=\s+•)"
STOP = r"(?<=[.?!][)\]\"'”’]{0,8})"
STOP_WITH_NUMBERS = r"(?<=[\p{L})][.?!]\d[\d,–-]{0,40})"
#: What follows is looked at first, as it is there at few places: white space and then a capital or a bullet. No end lies inside white
#: space, so a run of it is read once.
ENDS = rf"(?<=\S)(?=\s++[\p{{Lu}}•])(?:{BULLET}|(?=\s+\p{{Lu}})(?:{STOP}|{STOP_WITH_NUMBERS}))"


def sentence_parts(text: Column) -> Column:
    """The sentences of a text, each with the white space in front of it, so that they join to the text again."""
    return F.filter(F.split(text, ENDS), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences without the white space in front; see ENDS for where they end."""
    return F.filter(F.transform(sentence_parts(text), lambda s: F.regexp_replace(s, r"^\s+", "")), lambda s: s != "")


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))


@pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C; null stays null."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and without blanks; numbers keep their digits; null if it isn't JSON."""

    class Raw(float):
        def __new__(cls, raw: str):
            out = super().__new__(cls, raw)
            out.raw = raw
            return out

        def __repr__(self) -> str:
            return self.raw

    def one(t: str) -> str | None:
        try:
            value = json.loads(t, parse_float=Raw)
        except ValueError:
            return None
        return _dump(value)

    def _dump(v) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(_dump, v)) + "]"
        return repr(v) if isinstance(v, Raw) else json.dumps(v, ensure_ascii=False)

    return texts.map(one, na_action="ignore")


class Subsequence:
    """Longest common subsequences of two word lists, a row of the table in the bits of one number.

    Row i says for the words of ``a`` from i on: the zero bits among the lowest n bits count the longest common
    subsequence with the last n words of ``b``. A row comes from the next by one addition. A row in every STEP is kept, the
    others are made again when they are needed, so that memory grows with the root of the table's rows.
    """

    STEP = 64

    def __init__(self, a: list[str], b: list[str]):
        self.a, self.size = a, len(b)
        self.full = (1 << self.size) - 1
        self.spots: dict[str, int] = {}
        for k, word in enumerate(reversed(b)):
            self.spots[word] = self.spots.get(word, 0) | 1 << k
        self.kept, row = {len(a): self.full}, self.full
        for i in range(len(a) - 1, -1, -1):
            row = self._before(row, i)
            if i % self.STEP == 0:
                self.kept[i] = row
        self.block: dict[int, int] = {}

    def _before(self, row: int, i: int) -> int:
        hit = row & self.spots.get(self.a[i], 0)
        return (row + hit | row - hit) & self.full

    def _row(self, i: int) -> int:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            at = min(len(self.a), i - i % self.STEP + self.STEP)
            row, self.block = self.kept[at], {}
            for k in range(at - 1, i - i % self.STEP, -1):
                self.block[k] = row = self._before(row, k)
        return self.block[i]

    def length(self, i: int = 0, j: int = 0) -> int:
        """Length for the words of ``a`` from i on and of ``b`` from j on."""
        n = self.size - j
        return n - (self._row(i) & ((1 << n) - 1)).bit_count()


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    return Subsequence(a, b).length()


#: Texts or pairs of them that are held as Python objects at once.
PAIRS = 256


def _pairs(a: pa.Array, b: pa.Array, one: Callable, pack: Callable[[list], pa.Array]) -> pa.Array:
    """``one`` of each pair of texts, PAIRS at a time: what it gives is packed at once, so that a batch isn't held as Python objects."""
    firsts = range(0, max(len(a), 1), PAIRS)
    return pa.concat_arrays([pack([one(x, y) for x, y in zip(a.slice(k, PAIRS).to_pylist(), b.slice(k, PAIRS).to_pylist())]) for k in firsts])


@arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Twice the longest common subsequence of the words over all words; 1 for two texts without words, null with a null."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        p, q = re.findall(r"\w+", x.lower()), re.findall(r"\w+", y.lower())
        return 2 * common_length(p, q) / (len(p) + len(q)) if p or q else 1.0

    return _pairs(a, b, one, lambda some: pa.array(some, pa.float64()))


class Term:
    """A word to look for with a few missing, extra, wrong or swapped neighbouring letters.

    The distances of its beginnings to a word read so far are kept as rises and falls in the bits of two numbers, so that a
    letter costs a few operations whatever the term's length.
    """

    def __init__(self, term: str):
        self.term, self.top = term, 1 << max(len(term) - 1, 0)
        self.full = (1 << len(term)) - 1
        self.spots: dict[str, int] = {}
        for k, c in enumerate(term):
            self.spots[c] = self.spots.get(c, 0) | 1 << k
        #: Words under four letters allow no typo, from four on one, from eight on two.
        self.most = (len(term) >= 4) + (len(term) >= 8)

    def distance(self, word: str) -> int:
        if not self.term:
            return len(word)
        rise, fall, same, before, total = self.full, 0, 0, 0, len(self.term)
        for c in word:
            here = self.spots.get(c, 0)
            swapped = (~same & here) << 1 & before
            same = ((here & rise) + rise ^ rise | here | fall | swapped) & self.full
            up, down = fall | ~(same | rise) & self.full, same & rise
            total += bool(up & self.top) - bool(down & self.top)
            up = up << 1 | 1
            rise, fall = (down << 1 | ~(same | up)) & self.full, up & same & self.full
            before = here
        return total

    def near(self, word: str) -> bool:
        """Whether the word, or its start of the term's length, is within the allowed typos."""
        n = len(self.term)
        if not self.most or len(word) < n - self.most:
            return False
        return self.distance(word[:n]) <= self.most or (n < len(word) <= n + self.most and self.distance(word) <= self.most)


def fuzzy_match(query: str):
    """A boolean function of a text column: every word of ``query`` is in it, or within a few typos of a word or its start.

    Words under four letters allow none, from four on one, from eight on two. Whether a term stands in the text as it is,
    Spark tells; only the texts' distinct words are compared with terms, each once in a task.
    """
    terms = [Term(w) for w in dict.fromkeys(re.findall(r"[a-z0-9]+", query.lower()))]

    @pandas_udf(T.LongType())
    def near_terms(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}

        def near(word: str) -> int:
            if word not in known:
                if len(known) >= 50_000:
                    known.clear()
                known[word] = sum(1 << k for k, term in enumerate(terms) if term.near(word))
            return known[word]

        def any_of(row) -> int:
            found = 0
            for word in row if row is not None else ():
                found |= near(word)
            return found

        for part in words:
            yield part.map(any_of)

    def match(text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        low = F.lower(F.coalesce(text, F.lit("")))
        inside = F.lit(0).cast("long")
        for k, term in enumerate(terms):
            inside = inside.bitwiseOR(F.when(F.contains(low, F.lit(term.term)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
        words = F.array_distinct(F.regexp_extract_all(low, F.lit("([a-z0-9]+)")))
        return text.isNotNull() & (inside.bitwiseOR(near_terms(words)) == (1 << len(terms)) - 1)

    if len(terms) > 62:
        raise ValueError("a query may have 62 different words")
    return match


def word_count(part: Column) -> Column:
    """Words of a text, parted by white space."""
    return F.regexp_count(part, F.lit(r"\S+"))


def word_pieces(vocabulary: list[str], start: str = "▁", unknown: str = "[UNK]", longest: int = 100):
    """A function of an array of texts: the word pieces of each, greedily the longest first, accents stripped, punctuation apart.

    Pieces that begin a word carry ``start`` in the vocabulary. A word with a part that isn't in it, or of more than ``longest``
    letters, is one unknown piece.
    """
    begin = {v.removeprefix(start) for v in vocabulary if v.startswith(start)}
    inner = {f"##{v}" for v in vocabulary if not v.startswith(start)}
    numbers = {v: k for k, v in enumerate(sorted(begin | inner | {unknown}))}

    @pandas_udf("array<int>")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

        tok = Tokenizer(models.WordPiece(numbers, unk_token=unknown, max_input_chars_per_word=longest))
        tok.normalizer = normalizers.Sequence([normalizers.Lowercase(), normalizers.NFD(), normalizers.StripAccents()])
        tok.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
        for part in texts:
            yield part.map(lambda row: None if row is None else [len(e.ids) for e in tok.encode_batch_fast(list(row))])

    return count


def chunked(docs: DataFrame, text: str = "text", low: int = 250, high: int = 400, sizes=None, header: Column | None = None, out: str = "pieces") -> DataFrame:
    """``docs`` with ``out`` added: the text cut at sentences into pieces of ``low`` to ``high`` tokens, as an array of (offset, text, n_words).

    Of all cuts the one with fewest pieces above the limit, then fewest below, then fewest pieces, then sizes closest to the middle. A
    sentence above the limit is a piece of its own. Joined by their gaps the pieces give the text back. A null or empty text has none.
    ``sizes`` counts the tokens of an array of texts (see ``word_pieces``); without it words are counted. ``header`` is a text that goes before each
    piece and counts with it. Spark splits and joins the text; only the sentences' sizes are looked at one by one.
    """
    count = sizes or (lambda of: F.transform(of, word_count))

    @arrow_udf("array<struct<first:int,n:int,offset:int,n_words:int>>")
    def cuts(tokens: pa.Array, lengths: pa.Array, gaps: pa.Array, above: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(name, pa.int32()) for name in ("first", "n", "offset", "n_words")]))
        rows = lambda k: zip(*[x.slice(k, PAIRS).to_pylist() for x in (tokens, lengths, gaps, above)])
        return pa.concat_arrays([pa.array([pieces_of(*row, low, high) for row in rows(k)], kind) for k in range(0, max(len(tokens), 1), PAIRS)])

    # a generator of one row keeps the cut text from being computed again for every use
    rows = docs.withColumn("__parts", F.explode(F.array(sentence_parts(F.coalesce(F.col(text), F.lit(""))))))
    rows = rows.withColumn("__tokens", count(F.col("__parts"))).withColumn("__above", F.lit(0) if header is None else count(F.array(header))[0])
    lengths = F.transform("__parts", lambda s: F.length(s))
    gaps = F.transform("__parts", lambda s: F.length(s) - F.length(F.regexp_replace(s, r"^\s+", "")))
    rows = rows.withColumn("__cuts", cuts("__tokens", lengths, gaps, "__above"))

    def piece(c: Column) -> Column:
        whole = F.array_join(F.slice("__parts", c["first"] + 1, c["n"]), "")
        return F.struct(c["offset"].alias("offset"), F.when(c["first"] > 0, F.regexp_replace(whole, r"^\s+", "")).otherwise(whole).alias("text"), c["n_words"].alias("n_words"))

    return rows.withColumn(out, F.transform("__cuts", piece)).drop("__parts", "__tokens", "__above", "__cuts")


def pieces_of(tokens: list[int], lengths: list[int], gaps: list[int], above: int, low: int, high: int) -> list[dict]:
    """First sentence, number of sentences, offset behind the gap and tokens of each piece."""
    begin, first, out = 0, 0, []
    for end in best_cuts(tokens, above, low, high):
        out.append({"first": first, "n": end - first, "offset": begin + (gaps[first] if first else 0), "n_words": above + sum(tokens[first:end])})
        begin, first = begin + sum(lengths[first:end]), end
    return out


def best_cuts(tokens: list[int], above: int, low: int, high: int) -> list[int]:
    """After how many sentences each piece ends. Costs of all beginnings are carried on sentence by sentence, as one number each."""
    n, middle = len(tokens), (low + high) // 2
    total = [0]
    for t in tokens:
        total.append(total[-1] + t)
    widest = max(middle, total[-1] + above) ** 2 * max(n, 1) + 1  # larger than any sum of squares
    piece, below, beyond = (widest * (n + 1) ** k for k in range(3))
    # more than any cut costs; of equal costs the last way counts
    cost = [0] + [4 * (n + 1) * beyond] * n
    via = [0] * (n + 1)
    for i in range(n):
        base, shift = cost[i] + piece, total[i] - above + middle
        # as far as the limit allows, one sentence at least
        last = max(i + 1, bisect.bisect_right(total, total[i] + high - above) - 1)
        enough = bisect.bisect_left(total, total[i] + low - above, i + 1, last + 1)
        if total[last] - total[i] + above > high:
            base += beyond
        if i == 0 and enough > n:  # the whole text may be short
            cost[n], enough, last = base + (total[n] - shift) ** 2, n, n - 1
        for begin, end, own in ((i + 1, enough, base + below), (enough, last + 1, base)):
            for j in range(begin, end):
                off = total[j] - shift
                new = own + off * off
                if new <= cost[j]:
                    cost[j], via[j] = new, i
    out, at = [], n
    while at:
        out.append(at)
        at = via[at]
    return out[::-1]


def html_lines(page: Column) -> Column:
    """Headings and paragraphs of a page as (level, text): level 1 to 6 for headings, 0 for paragraphs."""
    parts = F.regexp_extract_all(page, F.lit(r"(?is)<(?:h[1-6]|p)\b[^>]*>[^<]*"), F.lit(0))
    level = lambda x: F.coalesce(F.try_to_number(F.regexp_extract(x, r"(?i)^<h([1-6])", 1), F.lit("9")), F.lit(0)).cast("int")
    lines = F.transform(parts, lambda x: F.struct(level(x).alias("level"), collapse(F.regexp_replace(x, r"^<[^>]*>", "")).alias("text")))
    return F.filter(lines, lambda x: x["text"] != "")


def joined_lines(lines: Column) -> Column:
    """One paragraph of an array of lines: a hyphen at a line's end joins two lower-case parts, otherwise a blank does.

    Empty lines before the first one with text are left out. A null line makes the paragraph null.
    """
    first = F.array_position(F.transform(lines, lambda x: x != ""), F.lit(True))
    rest = F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines))
    # each border is told from its two lines alone
    after = F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1)))
    parted = F.zip_with(
        rest,
        after,
        lambda x, y: F.when(y.isNull(), x).when(x.rlike(r"\p{Ll}-$") & y.rlike(r"^\p{Ll}"), F.regexp_replace(x, "-$", "")).otherwise(F.concat(x, F.lit(" "))),
    )
    return F.when(F.exists(lines, lambda x: x.isNull()), None).when(first == 0, "").otherwise(F.array_join(parted, ""))


def labelled_row(headers: Column, cells: Column) -> Column:
    """``header: value | header: value`` of two parallel arrays; empty and null cells are left out."""
    parts = F.zip_with(headers, cells, lambda h, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(h, F.lit(": "), F.trim(c))))
    return F.array_join(F.array_compact(parts), " | ")


def with_header(header: Column, body: Column) -> Column:
    """A body under its context header; without a header the body alone."""
    return F.when(F.coalesce(header, F.lit("")) == "", body).otherwise(F.concat(header, F.lit("\n"), body))


def without_header(text: Column, header: Column) -> Column:
    """The body again; a text that doesn't start with the header and a line's end stays as it is."""
    head = F.concat(header, F.lit("\n"))
    return F.when(F.startswith(text, head), F.substr(text, F.length(head) + 1)).otherwise(text)


def sub_items(text: Column, marker: str) -> Column:
    """A block cut at its markers as (label, text); what stands before the first marker has a null label.

    ``marker`` is a pattern whose first group is the label; each item goes up to the next marker. Empty leads are left out.
    """
    parts = F.filter(F.split(text, f"(?={marker})"), lambda p: p != "")
    label = lambda p: F.regexp_extract(p, f"^(?:{marker})", 1)
    return F.transform(parts, lambda p: F.struct(F.when(label(p) != "", label(p)).alias("label"), F.trim(F.regexp_replace(p, f"^(?:{marker})", "")).alias("text")))


def references(text: Column, label: str) -> Column:
    """Numbers of references such as ``Figure 3`` in a text, in order of their first place, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b{label}\s+(\d+)"), F.lit(1)), lambda x: x.cast("int")))


def answer_problem(answer: Column, headings: list[str]) -> Column:
    """The first problem of a structured answer, or null: each heading once and in order on a line of its own, other lines start with ``- ``."""
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    heads = F.filter(lines, lambda x: ~x.startswith("- "))
    want = F.array(*[F.lit(h) for h in headings])
    unknown = F.filter(heads, lambda x: ~F.array_contains(want, x))
    return (
        F.when(F.size(unknown) > 0, F.concat(F.lit("unexpected line: "), unknown[0]))
        .when(F.size(F.array_distinct(heads)) != F.size(heads), "heading twice")
        .when(heads != F.filter(want, lambda h: F.array_contains(heads, h)), "headings out of order")
        .when(F.size(heads) != len(headings), "heading missing")
    )


@arrow_udf(T.StructType([T.StructField("only_a", T.ArrayType(T.StringType())), T.StructField("only_b", T.ArrayType(T.StringType()))]))
def word_difference(a: pa.Array, b: pa.Array) -> pa.Array:
    """Words of either text that are not in their longest common subsequence; null counts as empty.

    Of several longest ones that is told which, word by word from the start, keeps equal words and gives up the first text's
    word where that costs nothing.
    """

    def one(x, y) -> tuple[list[str], list[str]]:
        left, right = (re.findall(r"\w+", t.lower()) if isinstance(t, str) else [] for t in (x, y))
        table = Subsequence(left, right)
        lost: tuple[list[str], list[str]] = ([], [])
        i = j = 0
        while i < len(left) and j < len(right):
            if left[i] == right[j]:
                i, j = i + 1, j + 1
            elif table.length(i + 1, j) == table.length(i, j):
                lost[0].append(left[i])
                i += 1
            else:
                lost[1].append(right[j])
                j += 1
        return lost[0] + left[i:], lost[1] + right[j:]

    lists = lambda some, k: pa.array([x[k] for x in some], pa.list_(pa.string()))
    return _pairs(a, b, one, lambda some: pa.StructArray.from_arrays([lists(some, 0), lists(some, 1)], ["only_a", "only_b"]))
