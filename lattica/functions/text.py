"""Text forms: watch requests, revision names, key-value lists and store locations."""

from __future__ import annotations

from urllib.parse import parse_qs, urlencode, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest revision, which stands for the head, and options that name no other store.
HEAD = (1 << 63) - 1
_ACCESS = ("ca", "cert", "key")
_CLIENT = ("compress", "read-only", "logfile", "cache-size")


def revision_name(rev: Column) -> Column:
    """16 hex digits; the largest revision is ``head``."""
    return F.when(rev == F.lit(HEAD), F.lit("head")).otherwise(F.lpad(F.lower(F.hex(rev)), 16, "0"))


def _quoted(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), x, F.lit('"'))


def watch_request(line: Column) -> Column:
    """struct(stream, oid, at, error) of a line ``<stream> watch <oid> (@<at>|-)``, ids as 16 hex
    digits. A null ``at`` without an error ends the watch. Null stays null."""
    blank = F.instr(line, " ")
    number = F.substring_index(line, " ", 1)
    stream = F.when((blank > 0) & number.rlike("^[0-9]+$"), number.try_cast("decimal(20,0)"))
    stream = F.when(stream <= F.lit("18446744073709551615").cast("decimal(20,0)"), stream)
    message = F.regexp_replace(F.substr(line, blank + 1), "\n$", "")
    args = F.split(F.substr(message, F.lit(len("watch ") + 1)), " ", -1)
    oid, at = F.get(args, F.lit(0)), F.get(args, F.lit(1))
    frame = F.concat(F.lit("invalid frame: "), _quoted(line))
    error = (
        F.when(blank == 0, frame)
        .when(stream.isNull(), F.concat(frame, F.lit(" (invalid stream)")))
        .when(~message.startswith("watch "), F.concat(F.lit("bad watch: not a watch request: "), _quoted(message)))
        .when(F.size(args) != 2, F.concat(F.lit("bad watch: expected 2 arguments, got "), F.size(args).cast("string")))
        .when(~oid.rlike("^[0-9a-fA-F]{16}$"), F.lit("bad watch: invalid oid"))
        .when(~at.rlike("^(-|@[0-9a-fA-F]{16})$"), F.lit("bad watch: invalid at"))
    )
    good = error.isNull()
    out = F.struct(stream.alias("stream"), F.when(good, F.lower(oid)).alias("oid"), F.when(good & (at != "-"), F.lower(F.substr(at, F.lit(2)))).alias("at"), error.alias("error"))
    return F.when(line.isNotNull(), out)


def kv_decode(text: Column) -> Column:
    """``1:a,2:b`` as a map of longs to strings; a repeated key fails, empty text is the empty map."""
    pairs = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ",", -1))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, ":", 1).cast("long"), F.substr(p, F.instr(p, ":") + 1))))


def kv_encode(kv: Column) -> Column:
    """The map as text, ascending by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(kv)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"])), ",")


def store_location(url: str) -> str:
    """One form for all clients of a store: without credentials and client options, the rest of the
    query and the master nodes in order. Credentials that are not empty imply the secure scheme."""
    scheme, net, path, query, fragment = urlsplit(url)
    if scheme in ("file", "zeo", "demo"):
        return urlunsplit((scheme, net, path, query, fragment))
    if scheme not in ("neo", "neos"):
        raise NotImplementedError(f"can't normalise a location of scheme {scheme}")
    options = parse_qs(query)
    if any(k in options for k in _ACCESS):
        scheme = "neos"
    kept = sorted((k, v) for k, v in options.items() if k not in _ACCESS + _CLIENT)
    cluster, at, masters = net.rpartition("@") if net.count("@") <= 1 else net.partition("@")
    return urlunsplit((scheme, cluster + at + ",".join(sorted(masters.split(","))), path, urlencode(kept, doseq=True), fragment))
