"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

A candidate is a stretch of text that looks like a credential. Each candidate's value is hashed and
counted over the whole corpus by distinct owners and distinct repositories. A value that many owners
carry is an example that got copied around (documentation, fixtures, templates); one that stays with
a single owner looks live.

Candidates of the base kinds ``assign``, ``access`` and ``hex`` are always reported. The ``bare``
kind, a long token of mixed character classes without any key word, is too noisy on its own and is
reported only where its ownership says that it is live.

Positions come without any user code: splitting a text at a pattern gives the pieces between the
matches and ``regexp_extract_all`` the matches, and a running sum over both lengths gives the start
of each match in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# The patterns of the base kinds and their least lengths.
KEYWORDS = "(password|passwd|secret|token|api_?key)"
ASSIGN = "(?i:" + KEYWORDS + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
# The added kind: at least 20 characters of a token alphabet, not all of one class.
BARE = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "bare")


def _spans(text: Column, kind: str, pattern: str, value_group: int) -> Column:
    """array<struct<start, end, kind, value>> of all leftmost matches that do not overlap."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = F.regexp_extract_all(text, F.lit(pattern), value_group)
    pieces = F.split(text, pattern, -1)
    # Walk along the matches; the sum so far is the end of the match before.
    zipped = F.arrays_zip(
        F.slice(pieces, 1, F.size(matches)).alias("piece"), matches.alias("found"), values.alias("value")
    )
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    walked = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["piece"]) + F.length(m["found"])).alias("at"),
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(m["piece"])).alias("start"),
                        (acc["at"] + F.length(m["piece"]) + F.length(m["found"])).alias("end"),
                        F.lit(kind).alias("kind"),
                        m["value"].alias("value"),
                    )
                ),
            ).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    # A text without a match needs no splitting.
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def candidates(docs: DataFrame, text: str = "text") -> Column:
    """All candidate spans of a text, the ones that fail their least length already gone."""
    t = whole_text(text)
    # [0-9a-f]+ over 16 characters and AKIA[A-Z0-9]+ over 18 match the same runs as the bounded forms,
    # since a run holds no second start that reaches further.
    assign = F.filter(_spans(t, "assign", ASSIGN, 2), lambda s: F.length(s["value"]) >= LEAST["assign"])
    access = _spans(t, "access", "AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4), 0)
    hexes = _spans(t, "hex", "[0-9a-f]{%d,}" % LEAST["hex"], 0)
    mixed = F.filter(
        _spans(t, "bare", BARE, 0),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & ~s["value"].rlike("^AKIA"),
    )
    return F.concat(assign, access, hexes, mixed)


def _order(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _line(spans: Column) -> Column:
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"], _order(s["kind"]).alias("rank"), s["end"], s["kind"]))
    )
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def ownership(spans: DataFrame) -> DataFrame:
    """Frequency of each candidate value: (value_hash, n_rows, n_owners, n_repositories).

    ``spans`` holds value_hash, owner and repository. Counted in two steps, so that a value which a
    third of all rows carry is reduced to its distinct (owner, repository) pairs before it meets
    itself in one task.
    """
    pairs = spans.groupBy("value_hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("value_hash", "owner").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories")
    )
    return owners.groupBy("value_hash").agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_owners"),
        F.sum("repositories").alias("n_repositories"),
    )


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
    example_owners: int = 3,
) -> DataFrame:
    """Spans of every row, judged by how many owners their value has in the corpus.

    Returns one row per input row: id, text_key (SHA-256 of the text) and ``spans`` (array of start,
    end, kind, live; ends are exclusive and count code points). A value is *live* while fewer than
    ``example_owners`` distinct owners carry it, else a copied example.

    Null texts count as empty and have no span; a null owner or repository is one of its own. Rows
    with equal id and text get equal answers, each its own row, and count as one row of their owner
    for everything but n_rows. An empty table gives an empty result. Other columns are ignored.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.sha2(whole_text(text_col), 256).alias("text_key"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        candidates(docs, text_col).alias("found"),
    )
    each = rows.select("id", "text_key", "owner", "repository", F.explode("found").alias("s")).select(
        "id", "text_key", "owner", "repository", "s.*", F.sha2(F.col("s.value"), 256).alias("value_hash")
    )
    judged = (
        each.join(ownership(each), "value_hash")
        .withColumn("live", F.col("n_owners") < example_owners)
        .filter((F.col("kind") != "bare") | F.col("live"))
        .groupBy(F.col("id").alias("judged_id"), F.col("text_key").alias("judged_key"))
        .agg(F.collect_set(F.struct("start", "end", "kind", "live")).alias("judged"))
    )
    # Ids may repeat with different texts, so a row finds its spans by both.
    keys = docs.select(F.col(id_col).alias("id"), F.sha2(whole_text(text_col), 256).alias("text_key"))
    own = F.col("id").eqNullSafe(F.col("judged_id")) & (F.col("text_key") == F.col("judged_key"))
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string,live:boolean>>")
    return keys.join(judged, own, "left").select("id", "text_key", F.coalesce("judged", nothing).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the scan query from the spans of :func:`scan_secrets`."""
    base = F.filter("spans", lambda s: s["kind"] != "bare")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        F.col("id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_line(base), 256).alias("base_sha256"),
        _line(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by ``mark``; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    walked = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, walked).otherwise(text)
