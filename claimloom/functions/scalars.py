"""Scalar building blocks: Column in, Column out; no Python runs on executors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import lexicon


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: str | Column) -> Column:
    """The trimmed text; null where nothing is left."""
    return F.nullif(F.trim(col(x)), F.lit(""))


def found(x: Column, pattern: str, group: int = 1) -> Column:
    """The first match of a pattern; null where there is none."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def lowered(x: Column) -> Column:
    """The text in lower case, every character in its old place."""
    low = F.lower(x)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # a dotted capital I becomes two characters
    return F.when(F.length(low) == F.length(x), low).otherwise(F.translate(x, upper, upper.lower()))


def opened_at(x: Column, low: Column, starts: Sequence[str]) -> Column:
    """The text from a few characters before the first of some lower-case words; empty without any.

    low: lowered(x). A pattern whose matches all start with one of the words, where
    nothing but a word border stands before it, finds the same here as in the whole text."""
    none = 2**31 - 1
    # whether a word is there takes far less time than where, and most aren't
    places = [F.when(low.contains(s), F.instr(low, s)) for s in starts]
    at = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(none))
    return F.when(x.isNotNull(), F.substring(x, F.greatest(at - 16, F.lit(1)), F.lit(none)))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value worked out once however often of names it."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with value as a column that is worked out once a row: a generator, through which
    no filter that names the column is pushed down to work it out again."""
    return df.withColumn(name, F.explode(F.array(value)))


def contains_any(x: Column, phrases: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | x.contains(p)
    return F.coalesce(out, F.lit(False))


def stripped(x: Column) -> Column:
    """x without white space around it, that of \\s in patterns."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def words(x: Column) -> Column:
    """Lower-case words; signs other than _ part them."""
    return F.array_remove(F.split(F.lower(x), r"[^a-z0-9_]+"), "")


def without(tokens: Column, noise: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*noise))


def distinct_without(tokens: Column, noise: Sequence[str]) -> Column:
    """The same without repeats."""
    return F.array_except(tokens, F.array(*map(F.lit, noise)))


# --- dates

# Digits in a fixed order: year, month, day, with signs or without.
_YEAR_FIRST, _EIGHT = r"^\d{4}([/-])\d{1,2}\1\d{1,2}$", r"^\d{8}$"
_MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _month(name: Column) -> Column:
    """1-12 for a month's name or its first three letters, else null."""
    known = F.array(*map(F.lit, (*_MONTH_NAMES, *(m[:3] for m in _MONTH_NAMES))))
    at = F.array_position(known, F.lower(name)).cast("int")
    return F.when(at > 0, (at - 1) % 12 + 1)


def parse_claim_date(x: str | Column) -> Column:
    """A date in one of twelve usual forms, or parts in a readable order.

    Shape and parts are worked out once. Impossible dates and other
    texts give null; a two-digit year in parts stays a year below 100.
    """
    bare = F.regexp_replace(F.trim(col(x)), "^['\"]+|['\"]+$", "")
    return let(F.nullif(bare, F.lit("")), lambda raw: let(_date_parts(raw), _date_of))


def _date_parts(raw: Column) -> Column:
    """The first three parts as numbers, the months that the first two name, and whether the year is known to come first."""

    def split_up(parts: Column) -> Column:
        one, two, three = (F.get(parts, F.lit(k)) for k in range(3))
        number = lambda p: F.when(p.rlike(r"^\d{1,4}$"), p.cast("int"))
        return F.struct(number(one).alias("n1"), number(two).alias("n2"), number(three).alias("n3"), _month(one).alias("m1"), _month(two).alias("m2"), raw.rlike(_YEAR_FIRST).alias("year_first"))

    digits = [F.substring(raw, a, n).cast("int") for a, n in ((1, 4), (5, 2), (7, 2))]
    none = F.lit(None).cast("int")
    whole = F.struct(*(d.alias(f"n{k}") for k, d in enumerate(digits, 1)), none.alias("m1"), none.alias("m2"), F.lit(True).alias("year_first"))
    return F.when(raw.rlike(_EIGHT), whole).otherwise(let(F.split(raw, r"[-/\s,.]+"), split_up))


def _date_of(t: Column | dict[str, Column]) -> Column:
    n1, n2, n3, m1, m2 = (t[k] for k in ("n1", "n2", "n3", "m1", "m2"))
    front = t["year_first"] | (m1.isNull() & m2.isNull() & (n1 > 1900))
    year = F.when(front, n1).otherwise(n3)
    month = F.coalesce(m2, m1, n2)
    day = F.when(m2.isNull() & m1.isNotNull(), n2).when(front, n3).otherwise(n1)
    # what no month has isn't tried: a failed try costs far more than a test
    can = month.between(1, 12) & day.between(1, 31) & (year > 0)
    first = F.when(can, F.make_date(year, month, F.lit(1)))
    return F.when(day <= F.dayofmonth(F.last_day(first)), F.date_add(first, day - 1))


_SIGNS = r"-/\s,."
_THREE = rf"^([^{_SIGNS}]++)[{_SIGNS}]++([^{_SIGNS}]++)[{_SIGNS}]++([^{_SIGNS}]++)"


def with_claim_dates(df: DataFrame, texts: dict[str, str | Column]) -> DataFrame:
    """df with a column for each text: parse_claim_date of it.

    Parts are columns of their own, each worked out once a row; lists of one element,
    by which an expression alone holds them, take several times as long."""
    kept = [*df.columns, *(n for n in texts if n not in df.columns)]
    bare = lambda x: F.regexp_replace(F.trim(col(x)), "^['\"]+|['\"]+$", "")
    out = df.withColumns({f"_{n}_raw": F.nullif(bare(x), F.lit("")) for n, x in texts.items()})
    out = out.withColumns({f"_{n}_p{k}": F.regexp_extract(f"_{n}_raw", _THREE, k) for n in texts for k in (1, 2, 3)})

    def number(n: str, k: int) -> Column:
        p, (at, size) = F.col(f"_{n}_p{k}"), ((1, 4), (5, 2), (7, 2))[k - 1]
        # eight digits are no three parts
        eight = F.when((p == "") & F.col(f"_{n}_raw").rlike(_EIGHT), F.substring(f"_{n}_raw", at, size).cast("int"))
        return F.when(p.rlike(r"^\d{1,4}$"), p.cast("int")).otherwise(eight)

    out = out.withColumns({f"_{n}_n{k}": number(n, k) for n in texts for k in (1, 2, 3)})
    out = out.withColumns({f"_{n}_m{k}": F.when(F.col(f"_{n}_n{k}").isNull(), _month(F.col(f"_{n}_p{k}"))) for n in texts for k in (1, 2)})
    out = out.withColumns({f"_{n}_year_first": F.when(F.col(f"_{n}_p1") == "", True).otherwise((F.length(f"_{n}_p1") == 4) & F.col(f"_{n}_raw").rlike(_YEAR_FIRST)) for n in texts})
    return out.withColumns({n: _date_of({k: F.col(f"_{n}_{k}") for k in ("n1", "n2", "n3", "m1", "m2", "year_first")}) for n in texts}).select(*kept)


def claim_date_text(d: Column) -> Column:
    return F.date_format(d, "dd/MM/yyyy")


# What is plausible by its shape alone, as most dates are.
_DAY, _YEAR, _SIGN, _NAME = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:19\d\d|20\d\d|2100)", r"[-/\s.]+", rf"(?:{'|'.join(lexicon.MONTHS)})[a-z]*"
_PLAUSIBLE = rf"(?i)^(?:(?:{_DAY}{_SIGN}){{2}}{_YEAR}|{_YEAR}(?:{_SIGN}{_DAY}){{2}}|(?:\d{{1,2}}{_SIGN}{_NAME}|{_NAME}{_SIGN}\d{{1,2}},?){_SIGN}\d{{4}})$"


def plausible_date(x: str | Column) -> Column:
    """Three parts, of which one names a month, or numbers that can be a date."""
    return F.when(F.trim(col(x)).rlike(_PLAUSIBLE), True).otherwise(_plausible_parts(col(x)))


def _plausible_parts(x: Column) -> Column:
    parts = F.split(F.trim(x), r"[-/\s.]+")
    named = F.exists(parts, lambda p: F.lower(F.substring(p, 1, 3)).isin(*lexicon.MONTHS))
    n = F.transform(F.filter(parts, lambda p: p.rlike(r"^\d{1,9}$")), lambda p: p.cast("long"))
    a, b, c = (F.get(n, F.lit(k)) for k in range(3))
    year_first = b.between(1, 31) & c.between(1, 31) & a.between(1900, 2100)
    year_last = a.between(1, 31) & b.between(1, 31) & c.between(1900, 2100)
    numeric = F.when(F.size(n) < 3, False).when(a > 1000, year_first).when(c > 1000, year_last).otherwise(False)
    return F.when(F.size(parts) < 3, False).when(named, True).otherwise(F.coalesce(numeric, F.lit(False)))


# --- amounts

_DECIMAL = r"^[+-]?[0-9]+([.][0-9]+)?$"


def parse_amount(x: str | Column, strip_rs: bool) -> Column:
    """The number in an amount text; null where it can't be read.

    strip_rs also drops "Rs.": page validation does, the amount audit doesn't.
    """
    signs = r"[,$₹]|Rs[.]" if strip_rs else r"[,$₹]"
    raw = F.trim(F.regexp_replace(col(x), signs, ""))
    return F.when(raw.rlike(_DECIMAL), raw.try_cast("decimal(18,2)"))


# --- names and numbers


def company_tokens(x: str | Column, noise: Sequence[str] = lexicon.COMPANY_NOISE) -> Column:
    """Words that tell companies apart, in order; all words where none does."""
    raw = words(col(x))
    core = F.filter(without(raw, noise), lambda t: F.length(t) > 1)
    return F.when(F.size(core) > 0, core).otherwise(raw)


def person_tokens(x: str | Column, titles: Sequence[str] = lexicon.PERSON_TITLES) -> Column:
    return without(words(col(x)), titles)


def facility_tokens(x: str | Column, noise: Sequence[str] = lexicon.FACILITY_NOISE) -> Column:
    return distinct_without(words(col(x)), noise)


def policy_key(x: str | Column) -> Column:
    """A policy number without separators and leading zeros."""
    return F.ltrim(F.translate(F.lower(col(x)), " \t\n\v\f\r-_/.", ""), F.lit("0"))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def is_administrator(x: str | Column, phrases: Sequence[str] = lexicon.ADMINISTRATORS) -> Column:
    return contains_any(F.lower(col(x)), phrases)


def requirement_line(x: str | Column) -> Column:
    """A clause line without its number."""
    return F.trim(F.regexp_replace(F.trim(col(x)), r"^[0-9.\-*)\s]+", ""))


def _cut_title(line: Column, words: str) -> Column:
    head = F.get(F.split(line, rf"(?i)\s+(?:{words})\s+"), F.lit(0))
    return F.trim(F.substring(F.trim(head), 1, 60))


def requirement_title(x: str | Column) -> Column:
    """What a clause line asks for: at most 60 characters before its conditions."""
    return _cut_title(requirement_line(x), "with|stating|and payment|supporting|issued by|duly")


def clause_title(x: str | Column) -> Column:
    """The same of a whole clause, of which only a leading number goes."""
    return _cut_title(F.trim(F.regexp_replace(col(x), r"^\d+[.)]\s*", "")), "with|stating|and payment|supporting")


def requirement_words(x: str | Column, stop: Sequence[str] = lexicon.REQUIREMENT_STOP) -> Column:
    return distinct_without(words(col(x)), stop)


def loose_bool(x: str | Column) -> Column:
    t = F.lower(F.trim(col(x)))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def loose_page_number(x: str | Column) -> Column:
    """A page number from 1 on; null for anything else."""
    t = F.trim(col(x))
    n = F.when(t.rlike(r"^\d{1,9}$"), t.cast("int"))
    return F.when(n >= 1, n)


def json_spans(x: str | Column) -> Column:
    """The outermost balanced {...} and [...] of a text, in order: a fold over characters
    that knows strings and escapes. What is opened and never closed is no span, but
    what lies inside it may be one."""
    raw = col(x)
    state = "struct<open:array<int>,quoted:boolean,escaped:boolean,at:int,spans:array<struct<start:int,end:int>>>"
    named = lambda *values: F.struct(*(v.alias(n) for v, n in zip(values, ("open", "quoted", "escaped", "at", "spans"), strict=True))).cast(state)
    zero = named(F.array().cast("array<int>"), F.lit(False), F.lit(False), F.lit(1), F.array().cast("array<struct<start:int,end:int>>"))

    def step(s: Column, c: Column) -> Column:
        inside = F.size(s["open"]) > 0
        opens, closes = c.isin("{", "[") & ~s["quoted"], c.isin("}", "]") & ~s["quoted"] & inside
        start = F.get(s["open"], F.size(s["open"]) - 1)
        # a span takes the place of those inside it
        spans = F.when(closes, F.concat(F.filter(s["spans"], lambda p: p["start"] < start), F.array(F.struct(start.alias("start"), s["at"].alias("end"))))).otherwise(s["spans"])
        stack = F.when(opens, F.array_append(s["open"], s["at"])).when(closes, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"])
        # quotes count inside brackets only: prose around them has apostrophes and quotes of its own
        quote = (c == '"') & inside & ~s["escaped"]
        return named(stack, s["quoted"] != quote, (c == "\\") & s["quoted"] & ~s["escaped"], s["at"] + 1, spans)

    folded = F.aggregate(F.split(raw, ""), zero, step)
    return F.transform(folded["spans"], lambda p: F.substring(raw, p["start"], p["end"] - p["start"] + 1))


def _parses(x: Column) -> Column:
    """x where it is one JSON object or array and nothing else, else null."""

    def checked(body: Column) -> Column:
        # the parser stops behind the first value; what follows it shows inside brackets of either kind
        closed = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}"))).isNotNull()
        alone = F.size(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).cast("array<variant>")) == 1
        return F.when(body.rlike(r"^[\[{]") & closed & alone, body)

    return let(F.regexp_replace(x, r"^\s+|\s+$", ""), checked)


def first_json_object(x: str | Column) -> Column:
    """The JSON object that a model's answer holds; null where it holds none.

    Candidates are tried until one parses: the first fenced block, or the text without
    one, as a whole, from its first to its last brace, and from its first to its last
    bracket; then the pairs of an action, its reason and its input; then the other
    fenced blocks, and balanced spans, objects first. An array becomes the object's
    document_results."""
    raw = col(x)
    fences = F.regexp_extract_all(raw, F.lit(r"(?s)```(?:json)?\s*(.*?)\s*```"), F.lit(1))
    clean = F.coalesce(F.get(fences, F.lit(0)), raw)
    first_of = lambda xs: F.get(F.filter(F.transform(xs, _parses), lambda c: c.isNotNull()), F.lit(0))
    pair = lambda key: found(raw, rf"""(?i)["']{key}["']\s*:\s*["']([^"']+)["']""")
    given = _parses(found(raw, r"""(?is)["']action_input["']\s*:\s*(\{.*?\})"""))
    told = F.to_json(F.struct(F.trim(pair("action")).alias("action"), F.coalesce(F.trim(pair("reason")), F.lit("Autonomous decision.")).alias("reason")))
    told = F.concat(F.substring(told, F.lit(1), F.length(told) - 1), F.lit(',"action_input":'), F.coalesce(given, F.lit("{}")), F.lit("}"))
    of_clean = let(clean, lambda c: F.coalesce(_parses(c), _parses(found(c, r"(?s)(\{.*\})")), _parses(found(c, r"(?s)(\[.*\])"))))
    of_spans = let(json_spans(raw), lambda spans: F.coalesce(first_of(F.filter(spans, lambda c: c.startswith("{"))), first_of(spans)))
    body = F.coalesce(of_clean, F.when(pair("action").isNotNull(), told), F.when(F.size(fences) > 1, first_of(fences)), F.when(raw.rlike(r"[{\[]"), of_spans))
    return let(body, lambda b: F.when(b.startswith("["), F.concat(F.lit('{"document_results":'), b, F.lit("}"))).otherwise(b))


def label_from_key(x: str | Column) -> Column:
    return F.initcap(F.replace(col(x), F.lit("_"), F.lit(" ")))


def token_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def token_diff(a: Column, b: Column) -> Column:
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def distinct_in_order(x: Column) -> Column:
    return F.array_distinct(F.filter(x, lambda t: t != ""))
