"""Streaming-SQL idioms rewritten to Spark SQL, so that Catalyst plans script and dialect parts as one.

Rewritten: TUMBLE, HOP, SESSION with _START, _END, _ROWTIME; JSON_OBJECT; MAP[...]; ROW(...); PROCTIME(); LATERAL TABLE(f(x));
FOR SYSTEM_TIME AS OF; and, once a script has created them, functions that shadow Spark's own names.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..functions.sketches import log_slots
from ..types import duration_ms, top_level_split

_CALL = re.compile(r"(?i)\b(TUMBLE|HOP|SESSION)(_START|_END|_ROWTIME|_PROCTIME)?\s*\(")


def closing(text: str, start: int) -> int:
    """Index of the bracket that closes the one at start."""
    pairs, depth, quote = {"(": ")", "[": "]"}, 0, ""
    opening = text[start]
    for i in range(start, len(text)):
        ch = text[i]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch == opening:
            depth += 1
        elif ch == pairs[opening]:
            depth -= 1
            if not depth:
                return i
    raise ValueError(f"unbalanced {opening} in {text!r}")


def interval_text(text: str) -> str:
    """INTERVAL '1' MINUTE to Spark's '60000 milliseconds'."""
    found = re.fullmatch(r"(?is)\s*INTERVAL\s*'\s*(\d+)\s*'\s*([A-Z]+)\s*(?:\(\d+\))?\s*", text)
    if not found:
        raise ValueError(f"no interval: {text!r}")
    return f"{duration_ms(f'{found[1]} {found[2].lower()}')} milliseconds"


def _replace_calls(text: str, pattern: re.Pattern, make) -> str:
    """Replace calls of functions outside quotes; make(match, arguments) gives the new text."""
    out, i = [], 0
    quoted = [(m.start(), m.end()) for m in re.finditer(r"'(?:[^']|'')*'", text)]
    for m in iter(lambda: pattern.search(text, i), None):
        if any(a <= m.start() < b for a, b in quoted):
            out.append(text[i : m.end()])
            i = m.end()
            continue
        end = closing(text, m.end() - 1)
        out += [text[i : m.start()], make(m, text[m.end() : end])]
        i = end + 1
    return "".join(out) + text[i:]


def _window(kind: str, args: str) -> str:
    parts = top_level_split(args)
    column, spans = parts[0], [interval_text(x) for x in parts[1:]]
    if kind == "SESSION":
        return f"session_window({column}, '{spans[0]}')"
    if kind == "HOP":  # slide first, then size
        return f"window({column}, '{spans[1]}', '{spans[0]}')"
    return f"window({column}, '{spans[0]}')"


def _window_call(m: re.Match, args: str) -> str:
    window, part = _window(m[1].upper(), args), (m[2] or "").upper()
    if part == "_START":
        return f"{window}.start"
    if part == "_END":
        return f"{window}.end"
    if part:
        return f"({window}.end - INTERVAL '0.001' SECOND)"  # the last millisecond of the window
    return window


def _json_object(m: re.Match, args: str) -> str:
    pairs = []
    for item in top_level_split(args):
        found = re.fullmatch(r"(?is)(?:KEY\s+)?('(?:[^']|'')*')\s*(?:VALUE\b|:|,)\s*(.+?)(?:\s+(?:NULL|ABSENT)\s+ON\s+NULL)?", item)
        if not found:
            raise ValueError(f"no member of a JSON object: {item!r}")
        pairs += [found[1], rewrite_expression(found[2])]
    absent = re.search(r"(?i)\bABSENT\s+ON\s+NULL\s*$", args)
    return f"to_json(named_struct({', '.join(pairs)}), map('ignoreNullFields', '{'true' if absent else 'false'}'))"


def _map_literals(text: str) -> str:
    pattern = re.compile(r"(?i)\bMAP\s*\[")
    i, out = 0, []
    for m in iter(lambda: pattern.search(text, i), None):
        end = closing(text, m.end() - 1)
        out += [text[i : m.start()], f"map({rewrite_expression(text[m.end() : end])})"]
        i = end + 1
    return "".join(out) + text[i:]


def rewrite_expression(text: str, created: frozenset[str] | set[str] = frozenset(), typed: bool = False) -> str:
    """Rewrite the idioms of one expression. Sketch functions, whose form depends on the type of what they take, are left as
    marks if typed, for :func:`resolve_sketches`; else they take values."""
    text = _replace_calls(text, _CALL, _window_call)
    text = _replace_calls(text, re.compile(r"(?i)\bJSON_OBJECT\s*\("), _json_object)
    text = _map_literals(text)
    text = _replace_calls(text, re.compile(r"(?i)(?<![\w.])ROW\s*\("), lambda m, a: f"struct({a})")
    text = _replace_calls(text, re.compile(r"(?i)\bPROCTIME\s*\("), lambda m, a: "current_timestamp()")
    for name in created:
        text = _replace_calls(text, re.compile(rf"(?i)(?<![\w.]){re.escape(name)}\s*\("), lambda m, a, n=name: _created(n, a))
    return text if typed else resolve_sketches(None, text)


def _created(name: str, args: str) -> str:
    parts = [rewrite_expression(x, {name}, typed=True) for x in top_level_split(args)]
    if name in SKETCHES:
        return f"{MARK}{name}({', '.join(parts)})"
    x = parts[0] if parts else "NULL"
    zone = parts[1] if len(parts) > 1 else "'GMT'"
    m = parts[1] if len(parts) > 1 else "NULL"
    # a BIGINT is milliseconds, an INT seconds, else a timestamp: typeof decides while planning
    seconds = (
        f"(CASE typeof({x}) WHEN 'bigint' THEN CAST(signum(CAST({x} AS BIGINT)) * floor(abs(CAST({x} AS BIGINT)) / 1000) AS BIGINT) "
        f"WHEN 'int' THEN CAST({x} AS BIGINT) ELSE unix_seconds(CAST(CAST({x} AS STRING) AS TIMESTAMP)) END)"
    )
    local = f"from_utc_timestamp(to_utc_timestamp(timestamp_seconds({seconds}), current_timezone()), {zone})"
    return {
        "to_timestamp": f"(CASE typeof({x}) WHEN 'bigint' THEN timestamp_millis(CAST({x} AS BIGINT)) ELSE timestamp_seconds(CAST({x} AS BIGINT)) END)",
        "to_long_timestamp": f"unix_millis(CAST({x} AS TIMESTAMP))",
        "to_date": f"to_date({local})",
        "to_hour": f"hour({local})",
        "line_separator": "'\\n'",
        "modular": f"(CASE WHEN {x} IS NULL OR {m} IS NULL OR {m} <= 0 OR CAST({x} AS BIGINT) = -9223372036854775808 THEN 0 ELSE CAST(abs(CAST({x} AS BIGINT)) % {m} AS INT) END)",
        "hyper_log_log_merge": f"hll_sketch_estimate(hll_union_agg({x}))",
        "percentile_merge": f"kll_sketch_get_quantile_double(kll_merge_agg_double({x}), {zone})",
    }[name]


#: Functions whose form depends on the type of what they take: partial sketches (binary) are merged, values are sketched.
SKETCHES = ("hyper_log_log", "hyper_log_log_temporary", "percentile", "percentile_temporary")
MARK = "__sketch_"
_MARKED = re.compile(rf"\b{MARK}(\w+)\s*\(")


def _sketch_forms(name: str, args: str, settings: dict[str, str]) -> list[str]:
    """The forms of a call, to be tried in this order; the one for values comes first of those for values."""
    parts = top_level_split(args)
    x, q = parts[0], parts[1] if len(parts) > 1 else "0.5"
    number = lambda key, default: float(settings.get(f"jobparam.{key}", default))
    slots = log_slots(int(number("hyperloglog.number.slot", 4096)))
    k = int(min(65535, max(8, 2 * number("percentile.compression.temporary", 100))))
    accuracy = int(100 * number("percentile.compression", 100))
    sketched = [f"hll_sketch_agg({v}, {slots})" for v in (x, f"CAST({x} AS STRING)")]
    if name == "hyper_log_log":
        return [f"hll_sketch_estimate(hll_union_agg({x}, true))", *[f"hll_sketch_estimate({v})" for v in sketched]]
    if name == "hyper_log_log_temporary":
        return sketched
    if name == "percentile_temporary":
        return [f"kll_sketch_agg_double(CAST({x} AS DOUBLE), {k})"]
    merged = f"coalesce(kll_sketch_get_quantile_double(kll_merge_agg_double({x}), CAST({q} AS DOUBLE)), double('NaN'))"
    return [merged, f"coalesce(percentile_approx(CAST({x} AS DOUBLE), {q}, {accuracy}), double('NaN'))"]


def resolve_sketches(spark, text: str, settings: dict[str, str] | None = None) -> str:
    """Replace marked sketch calls by the first of their forms that the analyser takes, inner calls first.

    A form is tried with a stand-in for the calls that are not decided yet; nothing runs. Without a session calls take values.
    """
    while marks := list(_MARKED.finditer(text)):
        m = marks[-1]  # the last call holds no other
        end = closing(text, m.end() - 1)
        forms = _sketch_forms(m[1], text[m.end() : end], settings or {})
        chosen = forms[1] if m[1] in ("hyper_log_log", "percentile") else forms[0]
        if spark is not None:
            errors = []
            for form in forms:
                try:
                    spark.sql(_standing_in(text[: m.start()]) + form + _standing_in(text[end + 1 :]))
                    chosen = form
                    break
                except AnalysisException as e:
                    errors.append(e)
            else:
                raise errors[-1]
        text = text[: m.start()] + chosen + text[end + 1 :]
    return text


def _standing_in(text: str) -> str:
    """Undecided calls as aggregates that take anything: partial sketches as binary, estimates as numbers."""
    while m := _MARKED.search(text):
        try:
            end = closing(text, m.end() - 1)
        except ValueError:  # the call holds the one that is tried
            text = text[: m.start()] + "max(" + text[m.end() :]
            continue
        x = top_level_split(text[m.end() : end])[0]
        stand = f"CAST(max(typeof({x})) AS BINARY)" if m[1].endswith("_temporary") else f"CAST(max(length(typeof({x}))) AS DOUBLE)"
        text = text[: m.start()] + stand + text[end + 1 :]
    return text


#: Names that _created knows, to be activated by CREATE FUNCTION.
CREATABLE = ("to_timestamp", "to_long_timestamp", "to_date", "to_hour", "line_separator", "modular", "hyper_log_log", "hyper_log_log_temporary", "hyper_log_log_merge", "percentile_temporary", "percentile_merge", "percentile")

#: Table functions of Spark; others are known by registration.
TABLE_FUNCTIONS = {"explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"}
_LATERAL = re.compile(r"(?is)(,|(?:LEFT\s+|CROSS\s+|INNER\s+)?JOIN)\s+LATERAL\s+TABLE\s*\(")


def _laterals(text: str, tables: set[str] | frozenset[str] = frozenset()) -> str:
    """LEFT JOIN LATERAL TABLE(f(x)) AS t(c, ...) ON TRUE: a table function gives its rows, any other function one row.

    Without a list of columns a function's one column is collect_result, as the session functions name it.
    """
    out, i = [], 0
    for m in iter(lambda: _LATERAL.search(text, i), None):
        end = closing(text, m.end() - 1)
        call = text[m.end() : end]
        tail = re.match(r"(?is)\s*(?:AS\s+)?(?!ON\b)(\w+)(?:\s*\(([^)]*)\))?", text[end + 1 :])
        if not tail:
            raise ValueError("LATERAL TABLE needs an alias")
        join = "CROSS JOIN" if m[1] == "," else m[1]
        name = re.match(r"\s*([\w.]+)", call)
        if name and name[1].lower() in {*TABLE_FUNCTIONS, *map(str.lower, tables)}:
            to = f"LATERAL {call.strip()} AS {tail[1]}" + (f"({tail[2].strip()})" if tail[2] else "")
        else:
            to = f"LATERAL (SELECT {call} AS {(tail[2] or 'collect_result').strip()}) AS {tail[1]}"
        out += [text[i : m.start()], f" {join} {to}"]
        i = end + 1 + tail.end()
    return "".join(out) + text[i:]


_AS_OF = re.compile(
    r"(?is)\bFROM\s+([\w.`]+)(?:\s+(?:AS\s+)?(\w+))?\s+(LEFT\s+(?:OUTER\s+)?|INNER\s+)?JOIN\s+([\w.`]+)\s+FOR\s+SYSTEM_TIME\s+AS\s+OF\s+([\w.`]+)(?:\s+(?:AS\s+)?(\w+))?\s+ON\s+(.+?)(?=\bWHERE\b|\bGROUP\b|\bORDER\b|\bLIMIT\b|$)"
)


def _as_of(spark, text: str, row_times: dict[str, str]) -> str:
    """A temporal join to a view of two structs, the left row and the right one, named like the query's aliases."""
    from ..operators.joins import as_of_join

    m = _AS_OF.search(text)
    if not m:
        return text
    left, la, how, right, at, ra, on = m.groups()
    la, ra = la or left, ra or right
    keys = []
    for clause in re.split(r"(?i)\s+AND\s+", on.strip()):
        a, b = [x.strip().strip("`").split(".") for x in clause.split("=")]
        if len(a) != 2 or len(b) != 2:
            raise ValueError(f"qualify the key columns: {clause}")
        a, b = (a, b) if a[0] == la else (b, a)
        keys.append((a[1], b[1]))
    l_, r_ = spark.table(left), spark.table(right)
    time = at.split(".")[-1]
    if right not in row_times:
        raise ValueError(f"{right} has no row time; declare a WATERMARK")
    l2 = l_.selectExpr(*[f"`{a}` AS k{i}" for i, (a, _) in enumerate(keys)], f"`{time}` AS t", "struct(*) AS `l`")
    r2 = r_.selectExpr(*[f"`{b}` AS k{i}" for i, (_, b) in enumerate(keys)], f"`{row_times[right]}` AS t2", "struct(*) AS `r`")
    joined = as_of_join(l2, r2, [(f"k{i}", f"k{i}") for i in range(len(keys))], "t", "t2", left_fields="l", right_fields="r", how="LEFT" if how and how.strip().upper().startswith("LEFT") else "INNER")
    name = f"_as_of_{abs(hash(text)) % 10**10}"
    joined.toDF(la, ra).createOrReplaceTempView(name)
    return text[: m.start()] + f"FROM {name} " + text[m.end() :]


_WINDOWED = re.compile(r"(?is)\bTABLE\s*\(\s*(TUMBLE|HOP|CUMULATE)\s*\(")


def _windowed_tables(text: str) -> str:
    """TABLE(TUMBLE(TABLE t, DESCRIPTOR(ts), size)), HOP (slide, size) and CUMULATE (step, size) to rows with window_start,
    window_end and window_time. A cumulating window's rows are in each of its steps that end after them."""
    while m := _WINDOWED.search(text):
        inner = closing(text, m.end() - 1)
        source, descriptor, *spans = top_level_split(text[m.end() : inner])
        name, column = re.sub(r"(?i)^TABLE\s+", "", source), re.fullmatch(r"(?is)DESCRIPTOR\s*\(\s*(.*?)\s*\)", descriptor)[1]
        spans = [interval_text(x) for x in spans]
        kind, end = m[1].upper(), closing(text, text.index("(", m.start()))
        if kind == "CUMULATE":
            step, size = (int(x.split()[0]) for x in spans)
            if size % step:
                raise ValueError("the size of a cumulating window is no multiple of its step")
            steps = f"explode(filter(transform(sequence(1, {size // step}), k -> make_dt_interval(0, 0, 0, k * {step} / 1000)), x -> _w.start + x > `{column}`))"
            rows = f"SELECT * EXCEPT (_w, _x), _w.start AS window_start, _w.start + _x AS window_end FROM (SELECT *, {steps} AS _x FROM (SELECT *, window({column}, '{spans[1]}') AS _w FROM {name}))"
        else:
            window = f"window({column}, '{spans[-1]}'" + (f", '{spans[0]}')" if kind == "HOP" else ")")
            rows = f"SELECT * EXCEPT (_w), _w.start AS window_start, _w.end AS window_end FROM (SELECT *, {window} AS _w FROM {name})"
        text = text[: m.start()] + f"(SELECT *, window_end - INTERVAL '0.001' SECOND AS window_time FROM ({rows}))" + text[end + 1 :]
    return text


def rewrite_query(spark, text: str, created: frozenset[str] | set[str] = frozenset(), row_times: dict[str, str] | None = None, *, settings: dict[str, str] | None = None, tables: set[str] | frozenset[str] = frozenset()) -> str:
    """Rewrite the idioms of a whole query; tables: names of registered table functions."""
    before = None
    while before != text:  # one temporal join at a time
        before, text = text, _as_of(spark, text, row_times or {})
    return resolve_sketches(spark, rewrite_expression(_laterals(_windowed_tables(text), tables), created, typed=True), settings)


def window_select(df: DataFrame, chosen: str, grouped: str) -> DataFrame:
    """SELECT chosen FROM df GROUP BY grouped, with window functions in both."""
    return df.sparkSession.sql(f"SELECT {rewrite_expression(chosen)} FROM {{src}} GROUP BY {rewrite_expression(grouped)}", src=df)
