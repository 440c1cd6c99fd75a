"""Column functions (JVM-side expressions only) for the text rules.

Every function takes and returns ``Column`` objects so they stay inside
whole-stage codegen; lists become folded ``contains`` ORs or higher-order
``filter``/``transform`` calls on arrays.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

def _char_ranges(chars: str) -> str:
    """Regex class body of contiguous code-point ranges (fewer tests per character)."""
    cps = sorted(ord(c) for c in chars)
    out, i = [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        lo, hi = cps[i], cps[j]
        out.append(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}")
        i = j + 1
    return "".join(out)


_WS_CLASS = "[" + _char_ranges(C.PY_WHITESPACE) + "]+"
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def per_session(fn):
    """Build a fixed expression once per SparkContext and reuse the Column objects.

    Expressions built from the fixed value lists are the same for every query; building them
    costs thousands of Python->JVM calls, so every query after the first reuses them.
    Arguments must be hashable (the frozen ``Params`` is)."""
    import functools

    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        from pyspark import SparkContext
        key = (SparkContext._active_spark_context.applicationId, args)
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]
    return wrapper


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading/trailing whitespace exactly like Python's ``str.strip()``."""
    return F.trim(col(c), F.lit(C.PY_WHITESPACE))


def contains_any(c, words: Iterable[str]) -> Column:
    """True when the string contains any of the words (substring test)."""
    c = col(c)
    out = None
    for w in words:
        e = c.contains(F.lit(w))
        out = e if out is None else (out | e)
    return out if out is not None else F.lit(False)


def any_regex(words: Iterable[str]) -> str:
    """One Java regex matching any of the literal words (for use inside lambdas, where a
    single ``rlike`` beats a chain of interpreted ``contains``)."""
    return "|".join(r"\Q" + w + r"\E" for w in words)


def first_listed(c, words: Iterable[str]) -> Column:
    """The first word of the list (list order, not text order) contained in c, else NULL."""
    c = col(c)
    return F.coalesce(*[F.when(c.contains(F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))


def ntz_micros(c) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), col(c))


def ntz_literal(dt) -> Column:
    """A TIMESTAMP_NTZ literal from a naive datetime, built from its text so neither the
    driver's nor the session's time zone can shift it."""
    return F.lit(dt.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def whole_days(later, earlier) -> Column:
    """Whole days later-earlier, floored like a Python timedelta's ``days``."""
    diff = F.timestamp_diff("MICROSECOND", col(earlier), col(later))
    return F.floor(diff / F.lit(86400000000)).cast("bigint")


def minute_text(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm")


def day_text(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def iso_text(c) -> Column:
    """ISO-8601 text like Python's ``isoformat()``: fraction only when non-zero."""
    c = col(c)
    base = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(c, "SSSSSS")
    return F.when(frac == F.lit("000000"), base).otherwise(F.concat(base, F.lit("."), frac))


def thread_name(subject, start) -> Column:
    """Date prefix + subject with every reply/forward marker removed anywhere, stripped after each."""
    s = F.coalesce(col(subject), F.lit(""))
    for p in C.SUBJECT_PREFIXES:
        s = strip(F.replace(s, F.lit(p), F.lit("")))
    return F.concat(day_text(start), F.lit(" - "), s)


def slug(name, ident) -> Column:
    """Folder label: invalid characters to '_', stripped, 50 chars, '_' and 8 chars of the id."""
    clean = F.translate(col(name), C.FOLDER_INVALID_CHARS, "_" * len(C.FOLDER_INVALID_CHARS))
    return F.concat(F.left(strip(clean), F.lit(C.SLUG_NAME_CHARS)), F.lit("_"),
                    F.left(F.coalesce(col(ident), F.lit("")), F.lit(C.SLUG_ID_CHARS)))


def preview(body, n: int = C.PREVIEW_CHARS) -> Column:
    """First n chars, LF to space, stripped, '...' when the body was longer."""
    b = col(body)
    head = strip(F.replace(F.left(b, F.lit(n)), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(b) > n, F.concat(head, F.lit("..."))).otherwise(head)


def snippet(body, n: int = C.SNIPPET_CHARS) -> Column:
    return strip(F.replace(F.left(col(body), F.lit(n)), F.lit("\n"), F.lit(" ")))


def sentences(body) -> Column:
    """'.'-separated sentences as array<struct<low, text>>: lower-cased, and stripped."""
    return F.transform(F.split(col(body), r"\.", -1), lambda s: F.struct(F.lower(s).alias("low"), strip(s).alias("text")))


def first_sentence_with(body, word, max_len: int) -> Column:
    """Stripped first '.'-separated sentence whose lower-case text contains word and whose
    stripped length is below max_len; NULL when none."""
    w = word if isinstance(word, Column) else F.lit(word)
    sents = F.split(col(body), r"\.", -1)
    hit = F.try_element_at(F.filter(sents, lambda s: F.lower(s).contains(w) & (F.length(strip(s)) < max_len)),
                           F.lit(1))
    return strip(hit)


def action_lines(body, cap: int = C.CAP_ACTIONS) -> Column:
    """First `cap` lines that ask or request something, stripped (length test on the raw line)."""
    words = any_regex(C.ACTION_WORDS)

    def wanted(line):
        return (line.contains("?") | F.lower(line).rlike(words)) & (F.length(line) < C.ACTION_LINE_MAX_LEN)
    lines = F.filter(F.split(col(body), "\n", -1), wanted)
    return F.slice(F.transform(lines, strip), 1, cap)


def clean_body(body) -> Column:
    """Body without greeting/signature/rule lines, single-spaced.

    A non-empty line is dropped when it is a short signature or a rule line;
    a short greeting is dropped only while fewer than two lines were kept.
    """
    greetings, signatures = any_regex(C.GREETINGS), any_regex(C.SIGNATURES)

    def feats(x):
        t, n = x["lt"], x["n"]
        greet = (n < C.GREETING_MAX_LEN) & t.rlike(greetings)
        sig = (n < C.SIGNATURE_MAX_LEN) & t.rlike(signatures)
        rule = F.length(F.translate(t, C.RULE_LINE_CHARS, "")) == 0
        eligible = (n > 0) & ~sig & ~rule
        return F.struct(x["text"].alias("text"), eligible.alias("ok"), greet.alias("greet"))

    stripped = F.transform(F.split(col(body), "\n", -1), strip)
    lowered = F.transform(stripped, lambda t: F.struct(t.alias("text"), F.lower(t).alias("lt"),
                                                         F.length(t).alias("n")))
    lines = F.transform(lowered, feats)
    # a greeting is kept from the second kept line on, that is, behind the second line that is eligible
    # and no greeting; one-element arrays bind what is used inside a lambda, so it is computed once
    def with_second(ls):
        plain = F.filter(F.transform(ls, lambda x, i: F.when(x["ok"] & ~x["greet"], i)), lambda i: i.isNotNull())
        return F.struct(ls.alias("lines"), F.coalesce(F.get(plain, F.lit(1)), F.lit(2**31 - 1)).alias("second"))

    def kept_text(s):
        kept = F.filter(s["lines"], lambda x, i: x["ok"] & (~x["greet"] | (i > s["second"])))
        return F.array_join(F.transform(kept, lambda x: x["text"]), " ")
    joined = F.get(F.transform(F.transform(F.array(lines), with_second), kept_text), F.lit(0))
    return strip(F.regexp_replace(joined, _WS_CLASS, " "))


def labels(flags: list[tuple[Column, str]]) -> Column:
    """Array of the labels whose flag is true, in order."""
    return F.array_compact(F.array(*[F.when(f, F.lit(t)) for f, t in flags]))


def bullet_list(arr: Column, prefix: str = "- ") -> Column:
    return F.array_join(F.transform(arr, lambda x: F.concat(F.lit(prefix), x, F.lit("\n"))), "")
