"""From signed deliveries to review jobs.

Every check is a column; what a server would answer with an error becomes a
``disposition`` and a ``reason``, so nothing is lost on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variant as V
from ..functions.binding import pin
from ..functions.signing import hmac_sha256_hex, stable_id
from .skew import lookup_join

# The handled event, its actions, and the formats of header and target fields.
HANDLED_EVENT = "pull_request"
HANDLED_ACTIONS = ("opened", "synchronize", "reopened")
MAX_DELIVERY_ID, MAX_EVENT_TYPE, MAX_ACTION, MAX_REPOSITORY = 255, 100, 100, 255
COMMIT = r"\A[0-9a-fA-F]{40}\z"

# Answer codes kept as labels.
LABELS = {"accepted": 202, "duplicate": 200, "ignored": 200, "invalid": 400, "unauthenticated": 401}

JOB_KEY = ("repository_name", "pull_request_number", "head_sha")
WHITESPACE = " \t\n\r\x0b\x0c"
JSON_BLANKS = " \t\n\r"


def verify_signature(df: DataFrame, secret: str) -> DataFrame:
    """Add ``authentic``: the ``sha256=`` header is the keyed digest of the raw body."""
    if not secret:
        raise ValueError("webhook secret is not configured")
    expected = F.concat(F.lit("sha256="), hmac_sha256_hex(F.col("body"), secret))
    return pin(df, authentic=F.coalesce(F.col("signature") == expected, F.lit(False)))


def check_headers(df: DataFrame) -> DataFrame:
    """Trim both headers and add ``headers_ok``."""
    # ``trim`` strips blanks only; a header may carry any white space around it.
    strip = lambda name: F.btrim(F.coalesce(F.col(name), F.lit("")), F.lit(WHITESPACE))
    trimmed = df.withColumn("delivery_id", strip("delivery_id")).withColumn("event_type", strip("event_type"))
    return trimmed.withColumn(
        "headers_ok",
        F.length("delivery_id").between(1, MAX_DELIVERY_ID) & F.length("event_type").between(1, MAX_EVENT_TYPE))


def parse_body(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``payload`` (VARIANT) and ``body_ok``: the body is UTF-8 JSON holding an object."""
    content = F.col(body)
    if dict(df.dtypes)[body] == "binary":
        content = F.try_validate_utf8(content.cast("string"))
    parsed = pin(df, payload=V.parse(content))
    # Valid JSON whose first character is a brace is an object.
    opens = F.ltrim(content, F.lit(JSON_BLANKS)).startswith("{")
    return parsed.withColumn("body_ok", F.col("payload").isNotNull() & opens)


def extract_target(df: DataFrame) -> DataFrame:
    """Add the target fields and ``target_ok``; a strict integer is neither true nor "7".

    Each object is opened once, outside in; its members are then looked at where they are.
    """
    held = pin(df, _payload=V.members(F.col("payload")))
    opened = pin(held, _repository=V.members(F.col("_payload")["repository"]), _pull=V.members(F.col("_payload")["pull_request"]),
                 _installation=V.members(F.col("_payload")["installation"]))
    inner = pin(opened, _head=V.members(F.col("_pull")["head"]), _base=V.members(F.col("_pull")["base"]))
    base = F.col("_base")["sha"]
    fields = pin(
        inner,
        action=V.as_text(F.col("_payload")["action"]),
        repository_id=V.as_whole(F.col("_repository")["id"]),
        repository_name=V.as_text(F.col("_repository")["full_name"]),
        pull_request_number=V.as_whole(F.col("_pull")["number"]),
        head_sha=V.as_text(F.col("_head")["sha"]),
        base_sha=V.as_text(base),
        installation_id=V.as_whole(F.col("_installation")["id"]),
        no_base=V.is_absent(base),
    ).drop("_payload", "_repository", "_pull", "_installation", "_head", "_base")
    base_ok = F.col("no_base") | F.coalesce(F.col("base_sha").rlike(COMMIT), F.lit(False))
    return fields.withColumn("target_ok", target_ok() & base_ok).drop("no_base")


def target_ok() -> Column:
    """Test on typed target columns."""
    positive = lambda name: F.col(name) > 0
    return F.coalesce(
        positive("repository_id") & positive("pull_request_number") & positive("installation_id")
        & F.length("repository_name").between(1, MAX_REPOSITORY) & F.col("head_sha").rlike(COMMIT),
        F.lit(False))


def classify_deliveries(df: DataFrame) -> DataFrame:
    """Add ``handled`` and ``full_action``; ``action`` becomes the label that is stored."""
    handled = (F.col("event_type") == HANDLED_EVENT) & F.col("action").isin(*HANDLED_ACTIONS)
    return (df.withColumn("handled", F.coalesce(handled, F.lit(False)))
            .withColumn("full_action", F.col("action")).withColumn("action", F.substring("action", 1, MAX_ACTION)))


def prepare(df: DataFrame, secret: str) -> DataFrame:
    """Stateless part for raw deliveries; the body and the parsed payload are dropped."""
    checked = parse_body(check_headers(verify_signature(df, secret)))
    return classify_deliveries(extract_target(checked)).drop("body", "payload", "signature")


def rejection() -> Column:
    """Why a delivery is refused, in the order of the checks; null when it is not."""
    return (F.when(~F.col("authentic"), "signature").when(~F.col("body_ok"), "body")
            .when(~F.col("headers_ok"), "headers").when(F.col("handled") & ~F.col("target_ok"), "target"))


def first_arrivals(df: DataFrame, key: str | list[str], order: tuple[str, ...] = ("received_at", "seq")) -> DataFrame:
    """The first row of each key.

    An aggregate, not a window: a delivery repeated a billion times is reduced to one row
    per task before anything moves.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [name for name in df.columns if name not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return kept.select(*keys, "_first.*").select(*df.columns)


def dedup_deliveries(df: DataFrame) -> DataFrame:
    """First arrival of each delivery id among those that pass every check.

    A refused delivery never claims its id, so a bad redelivery is refused, not duplicate.
    """
    return first_arrivals(df.filter(rejection().isNull()), "delivery_id")


def job_id(df: DataFrame) -> DataFrame:
    return df.withColumn("review_id", stable_id(*[F.col(name) for name in JOB_KEY]))


def deliveries_to_jobs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs, one per commit of a pull request, and the links from deliveries to them.

    ``df`` holds first arrivals. The id is a hash of the key, so a link needs no join
    and a replay produces the same rows.
    """
    targets = job_id(df.filter(F.col("handled")))
    links = targets.select("delivery_id", "review_id")
    first = F.struct("received_at", "seq")
    jobs = targets.groupBy("review_id", *JOB_KEY).agg(
        F.min_by(F.struct("installation_id", "repository_id", "received_at", "delivery_id"), first).alias("first"))
    jobs = jobs.select("review_id", *JOB_KEY, F.col("first.installation_id"), F.col("first.repository_id"),
                       F.col("first.received_at").alias("created_at"), F.col("first.delivery_id").alias("created_by"))
    return jobs, links


def delivery_disposition(df: DataFrame) -> DataFrame:
    """Each delivery with ``disposition``, ``reason`` and the answer ``label``.

    A delivery is the first of its id when its arrival equals the earliest passing one,
    which is one aggregated row per id; the rows themselves are joined, never grouped.
    """
    marked = df.withColumn("reason", rejection())
    arrival = F.struct("received_at", "seq")
    firsts = (marked.filter(F.col("reason").isNull()).groupBy("delivery_id")
              .agg(F.min(arrival).alias("_first")))
    joined = lookup_join(marked, firsts, ["delivery_id"])
    disposition = (F.when(F.col("reason") == "signature", "unauthenticated")
                   .when(F.col("reason").isNotNull(), "invalid")
                   .when(arrival != F.col("_first"), "duplicate")
                   .when(~F.col("handled"), "ignored").otherwise("accepted"))
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return (joined.withColumn("disposition", disposition)
            .withColumn("label", label[F.col("disposition")]).drop("_first"))


def pending_redeliveries(df: DataFrame, state: DataFrame) -> DataFrame:
    """Deliveries whose id is stored as still ``pending``; their job is queued again.

    ``state`` is the delivery table: ``delivery_id``, ``status``, ``review_id``.
    """
    pending = state.filter(F.col("status") == "pending").select("delivery_id", "review_id")
    return df.filter(rejection().isNull()).drop("review_id").join(pending, "delivery_id", "inner")


def insert_new(existing: DataFrame, incoming: DataFrame, key: tuple[str, ...] = JOB_KEY,
               order: tuple[str, ...] = ("seq",)) -> tuple[DataFrame, DataFrame]:
    """Manual inserts: the rows that are new, and the rows that conflict.

    Of several incoming rows with one key the first is inserted and the rest conflict.
    Rows must pass :func:`manual_ok`; filter or report the others before the call.
    """
    keys = list(key)
    first = F.min(F.struct(*order)).alias("_first")
    winners = (incoming.groupBy(*keys).agg(first)
               .join(existing.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left"))
    marked = lookup_join(incoming, winners, keys)
    inserted = F.col("_known").isNull() & (F.struct(*order) == F.col("_first"))
    pick = lambda condition: marked.filter(condition).select(*incoming.columns)
    return pick(inserted), pick(~inserted)


def manual_ok() -> Column:
    """Row test for a manual insert."""
    return F.coalesce(
        F.length("repository_name").between(1, MAX_REPOSITORY) & (F.col("pull_request_number") > 0)
        & F.length("head_sha").between(7, 40), F.lit(False))
