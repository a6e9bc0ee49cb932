"""Column functions over text: lines, trimming, truncation, redaction, human-readable numbers. No Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
#: Words of a key that make its value secret.
SENSITIVE_KEYS = ["TOKEN", "SECRET", "PASSWORD", "KEY", "CREDENTIAL", "AUTH"]
#: Flags whose value is secret.
SENSITIVE_FLAGS = ["-u", "--user", "-H", "--header", "--token", "--password", "--passwd", "--secret", "--api-key", "--apikey", "--auth", "--authorization"]
REDACTED = "[REDACTED]"


def strings(*values: str) -> Column:
    """An array of literals; an empty one is still an array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def lines(text: Column) -> Column:
    """Lines of a text as an array: \\n or \\r\\n ends a line, the last end opens none, an empty text has no line."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", strings()).otherwise(F.split(body, r"\r?\n"))


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def non_blank(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(lines(text), trim), lambda x: x != "")


def non_empty(text: Column) -> Column:
    """Lines as they are, without the empty ones."""
    return F.filter(lines(text), lambda x: x != "")


def one_space(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """What stands between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def truncated(text: Column, limit: int) -> Column:
    """At most `limit` characters; a cut is marked by an ellipsis that counts."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def truncated_middle(text: Column, limit: int) -> Column:
    """At most `limit` characters, begin and end kept around three dots."""
    keep = max(0, (limit - 3) // 2)
    tail = max(0, limit - 3 - keep)
    if limit <= 3:
        return F.when(F.length(text) > limit, F.lit("...")).otherwise(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."), F.substring(text, -tail, tail))).otherwise(text)


def around_match(text: Column, query: Column, width: int = 160) -> Column:
    """A window of `width` characters with the first match (case ignored) a third in; cut ends show three dots."""
    at = F.when(query.isNull() | (query == ""), F.lit(0)).otherwise(F.call_function("locate", F.lower(query), F.lower(text)) - 1)
    at = F.greatest(at, F.lit(0))
    size = F.length(text)
    start = F.least(F.greatest(at - width // 3, F.lit(0)), F.greatest(size - width, F.lit(0)))
    end = F.least(start + width, size)
    body = F.substring(text, start + 1, F.lit(width))
    dotted = F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(end < size, F.lit("...")).otherwise(F.lit("")))
    return F.when(size <= width, text).otherwise(dotted)


def more(shown: Column, total: Column, limit: int, label: str) -> Column:
    """The first `limit` of an array and, where there are more, a line that says how many."""
    note = F.concat(F.lit("+ "), (total - limit).cast("string"), F.lit(f" more {label}"))
    head = F.slice(shown, 1, limit)
    return F.when(total > limit, F.concat(head, F.array(note))).otherwise(head)


def preferred(stdout: Column, stderr: Column) -> Column:
    """The output that says something: one of both, or both by a line feed."""
    out, err = trim(stdout) != "", trim(stderr) != ""
    return F.when(out & err, F.concat(stdout, F.lit("\n"), stderr)).when(out, stdout).when(err, stderr).otherwise(F.lit(""))


def rendered_full(stdout: Column, stderr: Column) -> Column:
    """Both outputs one after the other, the error output from a new line on."""
    gap = F.when((stdout != "") & ~stdout.endswith("\n"), F.lit("\n")).otherwise(F.lit(""))
    end = F.when(stderr.endswith("\n") | (stderr == ""), F.lit("")).otherwise(F.lit("\n"))
    return F.when(stderr == "", stdout).otherwise(F.concat(stdout, gap, stderr, end))


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def looks_like_json(text: Column) -> Column:
    return trim(text).rlike(r"(?s)^(\{.*\}|\[.*\])$")


def json_object(text: Column) -> Column:
    """From the first { to the last }."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def duration_ms(text: Column) -> Column:
    """The last number with ms, s or m as milliseconds; null if there is none."""
    pattern = F.lit(r"(\d+(?:\.\d+)?)\s*(ms|s|m)\b")
    number = F.try_element_at(F.regexp_extract_all(text, pattern, F.lit(1)), F.lit(-1)).cast("double")
    unit = F.try_element_at(F.regexp_extract_all(text, pattern, F.lit(2)), F.lit(-1))
    return F.round(number * F.when(unit == "ms", 1).when(unit == "s", 1000).otherwise(60000)).cast("long")


def human_number(value: Column, units: int = 3) -> Column:
    """Thousands as K, M, B with one decimal, by the first `units` of them."""
    size = F.abs(value)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    text = size.cast("string")
    for limit, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B"))[:units]:
        text = F.when(size >= limit, F.format_string(f"%.1f{unit}", size / F.lit(limit))).otherwise(text)
    return F.concat(sign, text)


def human_bytes(value: Column, units: int = 3) -> Column:
    """Powers of 1024 as KB, MB, GB with one decimal, by the first `units` of them."""
    size = F.abs(value)
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"))[:units]:
        text = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / F.lit(float(1024**power)))).otherwise(text)
    return F.concat(sign, text)


def progress_bar(ratio: Column, width: int) -> Column:
    full = F.round(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full), F.lit("]"))


def plural(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, F.lit(one)).otherwise(F.lit(many))


def size_bytes(text: Column) -> Column:
    """A size with a unit (GB, MB, kB, B by thousands) in bytes; what can't be read counts as 0."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.upper(F.regexp_extract(text, r"^\s*[0-9.]+\s*([A-Za-z]*)", 1))
    factor = F.when(unit == "GB", 1e9).when(unit == "MB", 1e6).when(unit == "KB", 1e3).when(unit == "B", 1.0)
    return F.coalesce(F.nullif(number, F.lit("")).cast("double") * factor, F.lit(0.0))


def semantic_version(text: Column) -> Column:
    """Three integers that sort as a version does; what isn't there is 0."""
    parts = F.split(F.regexp_replace(text, r"^v|[-+].*$", ""), r"\.")
    number = [F.coalesce(F.try_element_at(parts, F.lit(k)).try_cast("int"), F.lit(0)) for k in (1, 2, 3)]
    return F.struct(number[0].alias("major"), number[1].alias("minor"), number[2].alias("patch"))


def printed_version(text: Column) -> Column:
    """The first word that begins with a digit."""
    return F.nullif(F.regexp_extract(text, r"(?:^|\s)(\d\S*)", 1), F.lit(""))


def extension(path: Column) -> Column:
    """What follows the last full stop of a file's name; null for dot files without another."""
    return F.nullif(F.regexp_extract(path, r"[^/.][^/]*\.([^/.]+)$", 1), F.lit(""))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def compact_path(path: Column, roots: tuple[str, ...] = ("src", "tests", "test", "lib")) -> Column:
    """From the last well-known root folder on; else the last two parts."""
    found = [F.nullif(F.regexp_extract(path, rf"^(?:.*/)?({root}/.*)$", 1), F.lit("")) for root in roots]
    return F.coalesce(*found, F.nullif(F.regexp_extract(path, r"([^/]+/[^/]+)$", 1), F.lit("")), path)


def uri_path(uri: Column) -> Column:
    """The path of a file:// address; null for others."""
    return F.when(uri.startswith("file://"), F.url_decode(F.regexp_replace(uri, "^file://(localhost)?", "")))


def normal_reference(raw: Column) -> Column:
    """The last segment (by : or .) of the last word, words made of letters, digits, _ : . only."""
    token = F.try_element_at(words(F.regexp_replace(raw, r"[^A-Za-z0-9_:.]", " ")), F.lit(-1))
    return F.coalesce(F.try_element_at(F.split(token, "[:.]"), F.lit(-1)), F.lit(""))


def content_hash(text: Column) -> Column:
    """16 hexadecimal digits; equal for equal contents."""
    return F.lower(F.lpad(F.hex(F.xxhash64(text)), 16, "0"))


def table_columns(line: Column) -> Column:
    """Columns two or more spaces apart; a line without such a gap falls at white space."""
    body = F.trim(line)
    wide = F.split(body, " {2,}")
    return F.when(F.size(wide) > 1, wide).otherwise(words(body))


# ---- redaction ----


def secret_value(value: Column) -> Column:
    return F.when(value == "", F.lit("")).otherwise(F.lit(REDACTED))


def is_secret_key(key: Column) -> Column:
    return F.upper(key).rlike("|".join(SENSITIVE_KEYS))


def redacted_argument(arg: Column) -> Column:
    """Headers as a whole; in an address, the values of secret query keys."""

    def pair(x: Column) -> Column:
        key, value = F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", "")
        return F.when(x.contains("=") & is_secret_key(key), F.concat(key, F.lit("="), secret_value(value))).otherwise(x)

    query = F.regexp_replace(arg, r"(?s)^[^?]*\?", "")
    address = F.concat(F.substring_index(arg, "?", 1), F.lit("?"), F.array_join(F.transform(F.split(query, "&"), pair), "&"))
    header = arg.contains("Authorization:") | arg.contains("authorization:") | arg.contains("Bearer ")
    return F.when(header, secret_value(arg)).when(arg.contains("?"), address).otherwise(arg)


def redacted_argv(argv: Column) -> Column:
    """Arguments without the values of secret flags (next argument or after =), of headers and of secret query keys."""
    flags = strings(*SENSITIVE_FLAGS)

    def step(state: Column, arg: Column) -> Column:
        flag = F.substring_index(arg, "=", 1)
        value = F.regexp_replace(arg, "(?s)^[^=]*=", "")
        with_value = arg.contains("=") & F.array_contains(flags, flag)
        alone = F.array_contains(flags, arg)
        out = F.when(state["next"], secret_value(arg)).when(with_value, F.concat(flag, F.lit("="), secret_value(value))).when(alone, arg).otherwise(redacted_argument(arg))
        return F.struct(F.concat(state["out"], F.array(out)).alias("out"), (~state["next"] & ~with_value & alone).alias("next"))

    start = F.struct(strings().alias("out"), F.lit(False).alias("next"))
    return F.aggregate(argv, start, step, lambda state: state["out"])


def redacted_source(text: Column, limit: int = 50) -> Column:
    """An address without user info and query, cut to `limit`."""
    plain = F.regexp_replace(F.regexp_replace(text, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1"), r"\?.*$", "")
    return truncated(plain, limit)


def env_value(key: Column, value: Column) -> Column:
    """Three stars for secret keys, the number of entries of paths, else the value cut to 60."""
    entries = F.size(F.filter(F.split(value, ":"), lambda x: x != ""))
    return F.when(is_secret_key(key), F.lit("***")).when(F.upper(key).endswith("PATH") & value.contains(":"), F.concat(entries.cast("string"), F.lit(" entries"))).otherwise(truncated(value, 60))


def shell_quoted(arg: Column) -> Column:
    quoted = F.concat(F.lit("'"), F.replace(arg, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    return F.when(arg == "", F.lit("''")).when(arg.rlike(r"^[A-Za-z0-9_\-./:=]+$"), arg).otherwise(quoted)


def rendered_argv(argv: Column) -> Column:
    return F.array_join(F.transform(argv, shell_quoted), " ")
