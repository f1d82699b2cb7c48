"""op11: damaged conversations, repaired."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentweave.llm.common import hex_digest, table
from rentweave.llm.role_repair import repair

FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def damage(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of sentence ends, repeated or given to the user, as a checksum of their place says."""
    blank = F.lit(" ")
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(place) % 20).alias("fate"))
    fate = F.col("fate")
    rows = rows.filter(fate != 0).withColumn("copy", F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def op11_role_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damage(turns))
    # A conversation's digest needs its lines in one value.
    lines = F.array_sort(F.collect_list(F.struct("run", "step", F.concat("role", F.lit(":"), "text").alias("line"))))
    digest = done.turns.groupBy("conv_id").agg(hex_digest(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("repaired_sha256"))
    out = turns.select("conv_id").distinct()
    for part in (done.summary, digest):
        part = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(part, out["conv_id"].eqNullSafe(part["_conv"]), "left").drop("_conv")
    return out.select(
        "conv_id",
        *[F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in FIGURES],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", hex_digest(F.lit(""))).alias("repaired_sha256"),
    )


def _sql() -> str:
    """The least (cost, audit) by dynamic programming over the four places of `(s?(ua)+)?`: before all, after s, after u, after a."""

    def way(place: str, cost: str, letters: str, line: str) -> str:
        return f"{{'c': {place}.c + {cost}, 'a': {place}.a || '{letters}', 'o': {place}.o || {line}}}"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    user, assistant = "'user:' || chr(10)", "'assistant:' || chr(10)"

    def padded(*p: str) -> list[str]:
        u = least(p[2], *[way(x, "3", "I", user) for x in (p[0], p[1], p[3])])
        a = least(p[3], way(p[2], "3", "I", assistant), *[way(x, "6", "II", f"{user} || {assistant}") for x in (p[0], p[1])])
        return [p[0], p[1], u, a]

    def deleted(p: str) -> str:
        return way(p, "4", "D", "''")

    own = "role || ':' || text || chr(10)"
    forced = "CASE WHEN must_go THEN 1000000000 ELSE 0 END"

    def kept(p: str, role: str) -> str:
        return way(p, f"CASE WHEN i = '{role}' THEN 0 ELSE 1000000000 END + {forced} + t", "K", own)

    def rerole(p: str, name: str) -> str:
        return way(p, f"3 + {forced} + t", "R", f"'{name}:' || text || chr(10)")

    row = [
        deleted("e0"),
        least(deleted("e1"), kept("e0", "s")),
        least(deleted("e2"), *[f(p, x) for p in ("e0", "e1", "e3") for f, x in ((kept, "u"), (rerole, "user"))]),
        least(deleted("e3"), kept("e2", "a"), rerole("e2", "assistant")),
    ]
    never = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 'o': ''}"
    crc = (
        "list_reduce([CAST(4294967295 AS BIGINT)] || flatten([[CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(place, '')]),"
        " lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"
    )
    seen = r"[^\x20\x09-\x0D]"
    pads = ", ".join(f"{e} AS e{i}" for i, e in enumerate(padded("n0", "n1", "n2", "n3")))
    return rf"""
WITH RECURSIVE placed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations
), fated AS (SELECT *, xor({crc}, 4294967295) % 20 AS fate FROM placed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE fate WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM fated WHERE fate <> 0
), numbered AS (
  SELECT *, row_number() OVER w AS rn, role[1:1] AS i, lag(role[1:1]) OVER w AS prior,
    NOT regexp_matches(text, '{seen}') AS blank
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), again AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) AS nth FROM numbered
), faulty AS (
  SELECT *, blank OR nth > 1 AS must_go, NOT blank AND nth = 1 AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM again
), counted AS (
  SELECT conv_id, max(rn) AS size, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE NOT blank AND nth > 1) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
    count(*) FILTER (WHERE prior IS NOT NULL AND prior || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), walk AS (
  SELECT conv_id, size, CAST(0 AS BIGINT) AS rn, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS n0, {never} AS n1, {never} AS n2, {never} AS n3 FROM counted
  UNION ALL
  SELECT conv_id, size, rn, {row[0]}, {row[1]}, {row[2]}, {row[3]}
  FROM (
    SELECT w.conv_id, w.size, f.rn, f.role, f.text, f.i, f.must_go, CASE WHEN f.cut THEN 3 ELSE 0 END AS t, {pads}
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.rn = w.rn + 1
  )
), ended AS (SELECT conv_id, {least("e0", "e3")} AS best FROM (SELECT conv_id, {pads} FROM walk WHERE rn = size))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(left(best.o, length(best.o) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


QUERIES = {"op11_role_repair": (op11_role_repair, _sql())}
