"""Scalar functions: guards, digests, timestamps, text measures. All are built from JVM expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def guarded(x: Column) -> Column:
    """FLT-01: finite and not negative, else null."""
    return F.when((x >= 0) & ~F.isnan(x.cast("double")) & (x.cast("double") < float("inf")), x)


def null_sum(*xs: Column) -> Column:
    """AGG rule for sums: null only if there are rows and all are null."""
    x = xs[0]
    return F.when(F.count(F.lit(1)) == 0, F.lit(0)).otherwise(F.sum(x))


def digest(*parts: Column) -> Column:
    """SCL-01: 24 hexadecimal digits that stand for the parts."""
    return F.substring(F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])), 256), 1, 24)


def present(json: Column, *keys: str) -> Column:
    """FLT-02: the value of the first key that exists, even if it is null."""
    own = F.json_object_keys(json)
    out = F.lit(None).cast("string")
    for k in reversed(keys):
        out = F.when(F.array_contains(own, k), F.get_json_object(json, f"$.{k}")).otherwise(out)
    return out


def safe_name(x: Column, default: str = "unknown") -> Column:
    """FLT-04: names of up to 160 harmless characters; anything that looks like a secret or an address becomes the default."""
    fine = x.rlike(r"^[\p{L}\p{N}_.():/@+ -]{1,160}$") & ~F.lower(x).rlike(r"bearer|sk-|://|\\")
    return F.when(F.coalesce(fine, F.lit(False)), x).otherwise(F.lit(default))


def instant(x: Column) -> Column:
    """SCL-02: epoch seconds or milliseconds (over 1e11), or ISO text with an offset; milliseconds are cut off, naive text is null."""
    number = x.try_cast("double")
    millis = F.floor(F.when(number > 1e11, number).otherwise(number * 1000)).cast("long")
    text = F.when(x.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.date_trunc("millisecond", F.try_to_timestamp(x)))
    return F.when(number.isNotNull(), F.timestamp_millis(millis)).otherwise(text)


def period_bound(x: Column, tz: str) -> Column:
    """FLT-09: the instant of a period's bound; text without an offset is local time of the report's zone."""
    naive = F.to_utc_timestamp(F.try_to_timestamp(F.when(~x.rlike(r"(Z|[+-]\d\d:?\d\d)$"), x)), tz)
    return F.coalesce(instant(x), naive)


def _accents() -> tuple[str, str]:
    """Letters that are a base letter with marks, and their bases (canonical decomposition); the marks themselves come last and have none."""
    bases = {c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn") for c in map(chr, range(0xC0, 0x2000))}
    pairs = [(c, b) for c, b in bases.items() if len(b) == 1 and b != c and unicodedata.category(c) != "Mn"]
    marks = "".join(c for c in map(chr, range(0x300, 0x2000)) if unicodedata.category(c) == "Mn")
    return "".join(c for c, _ in pairs) + marks, "".join(b for _, b in pairs)


ACCENTS = _accents()


def folded(x: Column) -> Column:
    """SCL-06: lower case without accents."""
    return F.translate(F.replace(F.lower(x), F.lit("ß"), F.lit("ss")), *ACCENTS)


def words(x: Column) -> Column:
    """SCL-07: Unicode words in lower case, without accents."""
    return F.regexp_extract_all(folded(x), F.lit(r"([\p{L}\p{N}_]+)"), 1)


#: SCL-09, fixed values: words that no question is searched by, and parts of identifiers that say nothing.
STOP_WORDS = (
    "a an and are as at be been being by can could did do does for from had has have how i if in into is it its may of on or our should so than that "
    "the their them then there these they this those to was we were what when where whether which who why will with without would you your "
    "implemented defined trace through including before after"
).split()
GENERIC_PARTS = "get set is has new init run value data default config error type".split()


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def primary_terms(x: Column, most: int = 32) -> Column:
    """SCL-09, SET-03: a question's distinct words in order, without stop words, the first `most` of them."""
    return F.slice(F.array_except(words(x), strings(STOP_WORDS)), 1, most)


def secondary_terms(x: Column, most: int = 48) -> Column:
    """SCL-09: parts of the identifiers and paths whose words are all primary terms or stop words."""
    stop = strings(STOP_WORDS)

    def of(first: Column) -> Column:
        tokens = F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}_./:-]+)"), 1)
        fine = F.filter(tokens, lambda t: F.size(F.array_except(words(t), F.concat(first, stop))) == 0)
        parts = F.flatten(F.transform(fine, split_identifier))
        return F.slice(F.array_except(parts, F.concat(stop, strings(GENERIC_PARTS), first)), 1, most)

    return _let(primary_terms(x), of)


def source_lines(x: Column) -> Column:
    """SCL-18: lines without their ends; a last line end starts no further line."""
    lines = F.split(F.regexp_replace(x, r"\r?\n\z", ""), r"\r?\n")
    return F.when(x == "", F.array().cast("array<string>")).otherwise(lines)


def normal_path(x: Column) -> Column:
    """SCL-19: slashes for backslashes; no empty, `.` and resolved `..` segments."""
    p = F.replace(x, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    up = p.startswith("/")

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        back = (s == "..") & (F.size(kept) > 0) & (F.coalesce(last, F.lit("")) != "..")
        return F.when(back, F.slice(kept, F.lit(1), F.size(kept) - 1)).when((s == "..") & up, kept).otherwise(F.concat(kept, F.array(s)))

    body = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(up, F.concat(F.lit("/"), body)).when(body == "", ".").otherwise(body)


def sanitised(x: Column) -> Column:
    """SCL-20: a space for each control character (tabs stay) and for line and paragraph separators."""
    return F.regexp_replace(x, "[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x9F\\u2028\\u2029]", " ")


def attribution_rank(x: Column) -> Column:
    """SCL-25: reported 0 (and anything unknown), recorded 1, the user's word 2."""
    return F.when(x == "recorded", 1).when(x == "user_override", 2).otherwise(0)


def shown_count(x: Column) -> Column:
    """SCL-31: thousands are set apart; half-even rounding; unknown stays unknown."""
    return F.coalesce(F.format_number(F.bround(x.cast("decimal(30,6)"), 0), 0), F.lit("unknown"))


def shown_money(lower: Column, upper: Column) -> Column:
    """SCL-31: one amount, a range, or one bound of it; four digits below a cent."""
    one = lambda x: F.when((x != 0) & (F.abs(x) < 0.01), F.concat(F.lit("$"), F.format_string("%.4f", x.cast("double")))).otherwise(F.concat(F.lit("$"), F.format_number(x.cast("decimal(30,6)"), 2)))
    both = F.when(F.abs(upper - lower) < 0.00005, one(lower)).otherwise(F.concat(one(lower), F.lit(" to "), one(upper)))
    return F.when(lower.isNull() & upper.isNull(), "unknown").when(lower.isNull(), F.concat(F.lit("up to "), one(upper))).when(upper.isNull(), F.concat(F.lit("at least "), one(lower))).otherwise(both)


def shown_minutes(x: Column) -> Column:
    """SCL-31: whole days, whole hours, or minutes."""
    n = F.bround(x.cast("decimal(20,4)"), 0).cast("long")
    text = F.when(n % 1440 == 0, F.concat((n / 1440).cast("long").cast("string"), F.lit(" d"))).when(n % 60 == 0, F.concat((n / 60).cast("long").cast("string"), F.lit(" h"))).otherwise(F.concat(n.cast("string"), F.lit(" min")))
    return F.when(x > 0, text).otherwise("unknown")


#: SCL-04, fixed values: tags that are put into a conversation, and what their text counts as.
TAGS = {"skills_instructions": "skill_catalog", "plugins_instructions": "plugin_instructions", "user_instructions": "instructions", "INSTRUCTIONS": "instructions", "environment_context": "environment", "tools": "tool_schemas"}


def tag_characters(x: Column, tag: str) -> Column:
    """SCL-04: characters of a tag's blocks, the tags included."""
    blocks = F.regexp_extract_all(x, F.lit(rf"(<{tag}(?:\s[^>]*)?>[\s\S]*?</{tag}>)"), 1)
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.length(b))


def remaining_category(role: Column) -> Column:
    """SCL-04: what text outside of all tags counts as."""
    return F.when(role.isin("system", "developer"), "instructions").when(role == "assistant", "assistant_messages").otherwise("user_messages")


def skill_names(arguments: Column) -> Column:
    """FLT-24: skills whose description file a tool's arguments name."""
    return F.array_distinct(F.regexp_extract_all(arguments, F.lit(r"([\p{L}\p{N}_.-]+)[/\\\\]+SKILL\.md"), 1))


def split_identifier(x: Column) -> Column:
    """SCL-05: parts of camel case, acronyms and snake case, lower-cased."""
    parted = F.regexp_replace(F.regexp_replace(x, r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(parted), F.lit(r"([\p{L}\p{N}]+)"), 1)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _cut(x: Column, suffix: str, by: str = "") -> Column:
    return F.concat(x.substr(F.lit(1), F.length(x) - len(suffix)), F.lit(by))


def stem(w: Column) -> Column:
    """SCL-08: the ordered suffix rules; words of up to three letters and words with other than a-z stay."""

    def singular(x: Column) -> Column:
        out = F.when(x.endswith("ies") & (F.length(x) > 4), _cut(x, "ies", "y")).when(x.endswith("sses"), _cut(x, "es"))
        return out.when(x.endswith("s") & ~x.rlike("(ss|us|is)$"), _cut(x, "s")).otherwise(x)

    def undoubled(x: Column) -> Column:
        twice = (F.length(x) > 2) & (F.right(x, F.lit(1)) == F.substring(x, -2, 1)) & ~F.right(x, F.lit(1)).rlike("[aeiou]")
        return F.when(twice, _cut(x, "x")).otherwise(x)

    def plain(x: Column) -> Column:
        bare = F.when(x.endswith("ing") & (F.length(x) > 5), _cut(x, "ing")).when(x.endswith("ed") & (F.length(x) > 4), _cut(x, "ed"))
        return F.coalesce(_let(bare, undoubled), x)

    def shorter(x: Column) -> Column:
        out = F.when(x.endswith("ization") & (F.length(x) > 9), _cut(x, "ization", "ize"))
        for suffix, by in (("ational", "ate"), ("ation", "ate"), ("fulness", "ful"), ("ness", ""), ("ment", "")):
            out = out.when(x.endswith(suffix) & (F.length(x) > len(suffix) + 2), _cut(x, suffix, by))
        return out.otherwise(x)

    def open_end(x: Column) -> Column:
        return F.when(x.endswith("e") & (F.length(x) > 3), _cut(x, "e")).otherwise(x)

    out = w
    for rule in (singular, plain, shorter, open_end):
        out = _let(out, rule)
    return F.when((F.length(w) > 3) & w.rlike("^[a-z]+$"), out).otherwise(w)


def token_estimate(x: Column) -> Column:
    """SCL-11: a token for every four characters, rounded up."""
    return F.ceil(F.length(x) / 4).cast("long")


def site_key(url: Column) -> Column:
    """SCL-22: the last two labels of the host, three below a country's second level."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    labels = F.split(host, r"\.")
    n = F.when(host.rlike(r"\.(co|com|org|net|gov|ac|edu)\.[a-z]{2}$"), 3).otherwise(2)
    return F.when(host != "", F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), "."))


def band(x: Column, good: float, poor: float) -> Column:
    """SCL-23: good up to one bound, poor above the other."""
    return F.when(x <= good, "good").when(x <= poor, "needs improvement").when(x > poor, "poor")


def html_text(x: Column) -> Column:
    """SCL-29: text without scripts, styles, comments and tags; block tags become line breaks."""
    bare = F.regexp_replace(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|article|section|nav|tr|table)[^>]*>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", ""), r"[ \t]*\n[ \t\n]*", "\n"))


#: FLT-18, fixed patterns: private keys up to their end mark or the end of the text, and five shapes of tokens, whole words only.
PRIVATE_KEY = r"-----BEGIN (?:[A-Z ]*PRIVATE KEY)-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)"
TOKEN = r"AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|xox[abp]-[A-Za-z0-9-]{20,}|sk-(?:proj-)?[A-Za-z0-9_-]{32,}"
WHOLE_TOKEN = rf"(?<![\p{{L}}\p{{N}}_])(?:{TOKEN})(?![\p{{L}}\p{{N}}_])"


def secret_count(x: Column) -> Column:
    return (F.regexp_count(x, F.lit(PRIVATE_KEY)) + F.regexp_count(x, F.lit(WHOLE_TOKEN))).cast("long")


def redacted(x: Column) -> Column:
    """FLT-20: every secret's text replaced, a private key's body with it."""
    return F.regexp_replace(F.regexp_replace(x, PRIVATE_KEY, "[redacted]"), WHOLE_TOKEN, "[redacted]")


def pattern_spans(x: Column, pattern: str) -> Column:
    """Lines (1-based, inclusive) that each match of a pattern covers: array of first and last."""
    breaks = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    pieces = F.arrays_zip(F.split(x, pattern, -1).alias("before"), F.regexp_extract_all(x, F.lit(f"({pattern})"), 1).alias("hit"))
    start = F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))

    def step(a: Column, z: Column) -> Column:
        first = a["line"] + breaks(z["before"])
        last = first + breaks(z["hit"])
        more = F.concat(a["spans"], F.array(F.struct(first.alias("first"), last.alias("last"))))
        return F.when(z["hit"].isNull(), a).otherwise(F.struct(last.alias("line"), more.alias("spans")))

    return F.aggregate(pieces, start, step, lambda a: a["spans"])


def secret_spans(x: Column) -> Column:
    """FLT-18: lines of private keys, then of tokens."""
    return F.concat(pattern_spans(x, PRIVATE_KEY), pattern_spans(x, WHOLE_TOKEN))


#: SCL-13, fixed patterns: paths of the past, of tests and of generated files.
PAST = (r"(?:^|/)(?:changelog|changes|news|history|release[-_]notes)(?:[./_-]|$)", r"(?:^|/)repo-maps/", r"(?:^|/)(?:reports?|artifacts|repomix|repo-mix|releases)/")
TESTS = (r"(?:^|/)(?:tests?|__tests__|fixtures?|playground)(?:/|_)", r"(?:\.test|\.spec)\.")
GENERATED = (r"(?:^|/)(?:vendor|vendored|generated|node_modules)(?:/|$)", r"\.min\.(?:js|css)$")


def path_prior(path: Column, from_docs: Column | None = None, docs_question: bool = False, disabled: tuple[str, ...] = ()) -> Column:
    """SCL-13, UDF-09: history 0.4, tests 0.6, generated 0.4, documentation 1.25 where documentation is asked for and nothing is matched exactly;
    each can be disabled."""
    p, out = F.lower(path), F.lit(1.0)
    for name, patterns, by in (("history", PAST, 0.4), ("tests", TESTS, 0.6), ("generated", GENERATED, 0.4)):
        if name not in disabled:
            out = out * F.when(p.rlike("|".join(patterns)), by).otherwise(1.0)
    if docs_question and from_docs is not None and "docs" not in disabled:
        out = out * F.when(from_docs, 1.25).otherwise(1.0)
    return out
