"""Detection as Column expressions: patterns to spans, context, overlap, profile filter.

The expressions are written as SQL text: one literal expression per pattern, chosen at plan time by locale, so a row
runs the patterns of its own locale only and everything stays in one narrow projection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.sources.catalog import Catalog, Pattern
from larkspur.sources.entities import OTHER_RANK, SPANS_SQL, SPECIFICITY
from larkspur.sources.profiles import Profile

CONTEXT_CHARS = 100
CONTEXT_BOOST = 0.25
#: Characters on which Java's and Python's classes differ. Texts with them are matched with the classes spelled out, and
#: with a stand-in of the same kind, one for one, for each character beyond the first plane, which Java reads as two.
GUARD = r"[\p{M}\p{No}\p{Nl}\x1c-\x1f]|[\x{10000}-\x{10FFFF}]"
_BEYOND = r"[\x{10000}-\x{10FFFF}&&"
# Stand-ins for a digit, another number, a letter and anything else.
STAND_INS = [(_BEYOND + r"[\p{Nd}]]", "\u0660"), (_BEYOND + r"[\p{N}]]", "\u00bd"), (_BEYOND + r"[\p{L}]]", "\u02ac"), (r"[\x{10000}-\x{10FFFF}]", "\ue000")]


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bind(expression: str, name: str, body: str) -> str:
    """SQL that computes an expression once and uses it by a name."""
    return f"element_at(transform(array({expression}), {name} -> {body}), 1)"


def no_spans() -> str:
    return f"cast(array() as {SPANS_SQL})"


def flattened_sql(text: str) -> str:
    """A text with stand-ins for its characters beyond the first plane."""
    for regex, char in STAND_INS:
        text = f"regexp_replace({text}, {quoted(regex)}, {quoted(char)})"
    return text


def pattern_spans(pattern: Pattern, ordinal: int, text: str = "text", lowered: str = "low", seen: str | None = None, odd: str | None = None) -> str:
    """SQL for all spans of a pattern in a text: the matches, and the gaps between them for the offsets.

    seen, odd: the text with stand-ins, and whether it has characters of GUARD; without them a text is taken as plain.
    """
    plain, source = quoted(pattern.java), quoted(f"pattern:{pattern.locale}")
    regex = f"if({odd}, {quoted(pattern.strict)}, {plain})" if odd else plain
    searched = seen or text
    start = "aggregate(slice(g, 1, i + 1), 0, (a, x) -> a + length(x)) + aggregate(slice(m, 1, i), 0, (a, x) -> a + length(x))"
    confidence = f"{pattern.confidence!r}D"
    if pattern.context_words:
        around = f"substring({lowered}, greatest(s - {CONTEXT_CHARS}, 0) + 1, s + length(x) + {CONTEXT_CHARS} - greatest(s - {CONTEXT_CHARS}, 0))"
        near = " or ".join(f"contains(w, {quoted(word.lower())})" for word in pattern.context_words)
        confidence = _bind(around, "w", f"if({near}, least(1.0D, {confidence} + {CONTEXT_BOOST}D), {confidence})")
    own = f"if({odd}, substring({text}, s + 1, length(x)), x)" if odd else "x"
    span = f"struct(s as start, {ordinal} as ord, s + length(x) as end, {own} as text, {quoted(pattern.entity_type)} as entity_type, {confidence} as confidence, {source} as source)"
    found = _bind(f"split({searched}, {regex}, -1)", "g", f"transform(m, (x, i) -> {_bind(start, 's', span)})")
    return _bind(f"regexp_extract_all({searched}, {regex}, 0)", "m", f"if(size(m) = 0, {no_spans()}, cast({found} as {SPANS_SQL}))")


def spans_of_sql(patterns: Callable[[str, str], str], text: str = "text") -> str:
    """SQL that runs an expression over a text with what it needs bound: low, and what patterns gets as seen and odd."""
    inner = _bind(f"if(odd, {flattened_sql(text)}, {text})", "seen", _bind(f"lower({text})", "low", patterns("seen", "odd")))
    return _bind(f"coalesce({text} rlike {quoted(GUARD)}, false)", "odd", inner)


def prefilter_sql(text: str = "text") -> str:
    """SQL for what any text has in which a built-in pattern can match: a digit, or a mark of those seven that need none.

    One character class and plain searches: much faster over long texts than one expression with alternatives.
    """
    plain = " or ".join(f"contains({text}, {quoted(x)})" for x in ("://", "eyJ", "AKIA"))
    token = f"(contains({text}, 'gh') and {text} rlike {quoted('gh[psorhtu]_')})"
    pairs = f"((contains({text}, ':') or contains({text}, '-')) and {text} rlike {quoted('[0-9A-Fa-f][:-][0-9A-Fa-f]')})"
    return f"({text} rlike {quoted(r'[\p{Nd}@]')} or {plain} or {token} or {pairs})"


def detect_sql(catalog: Catalog, locales: Iterable[str] | None = None, text: str = "text", locale: str = "locale", prefilter: bool = True) -> str:
    """SQL for the raw spans of a text in its locale, in order of start and then of the catalogue."""
    order = {id(p): i for i, p in enumerate(catalog.all())}

    def part(where: str) -> str:
        own = [pattern_spans(p, order[id(p)], text, "low", "seen", "odd") for p in catalog.all() if p.locale == where]
        return f"concat({', '.join(own)})" if own else no_spans()

    listed = part("GLOBAL")
    if cases := " ".join(f"when {quoted(x)} then {part(x)}" for x in ([y for y in catalog.locales() if y != "GLOBAL"] if locales is None else locales)):
        listed = f"concat({listed}, case {locale} {cases} else {no_spans()} end)"
    found = f"array_sort({spans_of_sql(lambda *_: listed, text)})"
    some = f"{text} is not null" + (f" and {prefilter_sql(text)}" if prefilter and not catalog.custom else "")
    return f"case when {some} then {found} else {no_spans()} end"


def rank_sql(entity_type: str) -> str:
    cases = " ".join(f"when {entity_type} in ({', '.join(map(quoted, names))}) then {rank}" for rank, names in SPECIFICITY.items())
    return f"case {cases} else {OTHER_RANK} end"


def dedupe_sql(spans: str) -> str:
    """SQL that resolves overlaps from left to right.

    Kept spans never overlap, so a new one can only meet the last kept. On the same span the higher confidence wins,
    otherwise the more specific type, then the longer span, then the higher confidence; the first stays on a tie.
    """
    last = "element_at(acc, -1)"
    same = "x.start = l.start and x.end = l.end"
    key = "struct({0} as r, {1}.end - {1}.start as n, {1}.confidence as c)"
    better = f"{key.format(rank_sql('x.entity_type'), 'x')} > {key.format(rank_sql('l.entity_type'), 'l')}"
    wins = f"if({same}, x.confidence > l.confidence, {better})"
    step = f"case when size(acc) = 0 then array(x) when x.start >= {last}.end then concat(acc, array(x)) else {_bind(last, 'l', f'if({wins}, concat(slice(acc, 1, size(acc) - 1), array(x)), acc)')} end"
    return f"aggregate({spans}, {no_spans()}, (acc, x) -> {step})"


def merge_persons_sql(spans: str, text: str = "text") -> str:
    """SQL that joins neighbouring PERSON spans with one or two visible characters between them, without a tagger."""
    gap = f"regexp_replace(substring({text}, l.end + 1, x.start - l.end), '(?U)^\\\\s+|\\\\s+$', '')"
    joined = f"named_struct('start', l.start, 'ord', l.ord, 'end', x.end, 'text', substring({text}, l.start + 1, x.end - l.start), 'entity_type', 'PERSON', 'confidence', greatest(l.confidence, x.confidence), 'source', if(l.confidence >= x.confidence, l.source, x.source))"
    merge = _bind(gap, "gap", f"if(l.entity_type = 'PERSON' and x.entity_type = 'PERSON' and x.start >= l.end and length(gap) between 1 and 2, concat(slice(acc, 1, size(acc) - 1), array({joined})), concat(acc, array(x)))")
    return f"aggregate({spans}, {no_spans()}, (acc, x) -> if(size(acc) = 0, array(x), {_bind('element_at(acc, -1)', 'l', merge)}))"


def heuristic_filter_sql(spans: str) -> str:
    """SQL that drops PERSON spans that don't start with a capital, or are one word of under three characters."""
    words = "split(regexp_replace(x.text, '(?U)^\\\\s+|\\\\s+$', ''), '(?U)\\\\s+')"
    first = "element_at(w, 1)"
    good = f"length({first}) > 0 and substring({first}, 1, 1) rlike '^\\\\p{{Lu}}' and (size(w) > 1 or length({first}) >= 3)"
    return f"filter({spans}, x -> x.entity_type <> 'PERSON' or {_bind(words, 'w', good)})"


def profile_filter_sql(spans: str, profile: Profile) -> str:
    """SQL that keeps spans whose type has a disposition and whose confidence reaches its threshold."""
    by: dict[float, list[str]] = {}
    for d in profile.dispositions.values():
        by.setdefault(d.confidence_threshold, []).append(d.entity_type)
    tests = " or ".join(f"(x.confidence >= {c!r}D and x.entity_type in ({', '.join(map(quoted, names))}))" for c, names in by.items())
    return f"filter({spans}, x -> {tests or 'false'})"


def detect(catalog: Catalog, text: str = "text", locale: str = "locale") -> Column:
    """Raw spans; see detect_sql."""
    return F.expr(detect_sql(catalog, text=text, locale=locale))


def dedupe(spans: str = "spans") -> Column:
    return F.expr(dedupe_sql(spans))


def merge_persons(spans: str = "spans", text: str = "text") -> Column:
    return F.expr(merge_persons_sql(spans, text))


def heuristic_filter(spans: str = "spans") -> Column:
    return F.expr(heuristic_filter_sql(spans))


def profile_filter(profile: Profile, spans: str = "spans") -> Column:
    return F.expr(profile_filter_sql(spans, profile))
