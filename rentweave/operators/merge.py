"""Order-exact priority merge of listings that share a canonical key.

The reference semantics are a left fold over rows in arrival order. The fold is equivalent to the closed form
used here. Within a key, with rows in arrival order:

* a row is a *record* when it is the first, or outranks every earlier priority, or ties the best priority so far
  and was first seen before every earlier row;
* ``rank`` is the row's arrival number for a record and its negative otherwise;
* a scalar is the non-null value of greatest rank (the last record that has one, else the earliest row that has);
* photos are concatenated by falling rank; map keys take the value of greatest rank; seen-on is a set union.

``max by rank`` is associative, so partial aggregation does most of the work before the shuffle. Only the
record flag needs a running maximum. Keys that are too big for one task get it in two levels: inside runs of
arrival order (chunks), then across the few chunk summaries of the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentweave import schema as S
from rentweave.operators.packing import deal, pack, unpack
from rentweave.operators.skew import HotKeys, find_hot_keys
from rentweave.session import compile_wide_rows, join_in_place

KEY = "canonical_key"

# Leaf columns resolved by rank, with their path in the canonical schema.
SCALAR_LEAVES: dict[str, str] = {
    "price__rent_net": "price.rent_net",
    "price__extras": "price.extras",
    "price__total": "price.total",
    "price__currency": "price.currency",
    "price__deposit_months": "price.deposit_months",
    "rooms": "rooms",
    "area_m2": "area_m2",
    "floor": "floor",
    "total_floors": "total_floors",
    "built_year": "built_year",
    "renovated_year": "renovated_year",
    "location__coords": "location.coords",
    "location__address": "location.address",
    "location__postal_code": "location.postal_code",
    "location__city": "location.city",
    "location__region": "location.region",
    "location__country": "location.country",
    "location__neighborhood": "location.neighborhood",
    "description": "description",
    "agency": "agency",
    "contact__email": "contact.email",
    "contact__phone": "contact.phone",
    "contact__form_url": "contact.form_url",
    "available_from": "available_from",
    "lease_until": "lease_until",
    "rental_term": "rental_term",
}
LEAF_DEFAULTS = {"price__currency": "CHF", "location__country": "CH", "rental_term": "unknown"}
MAP_PARTS: dict[str, str] = {
    "features": "features",
    "extra": "extra",
    "lister": "enriched.lister",
    "attrs": "enriched.attrs",
}
# Columns that hold collections.
_COLLECTIONS = ["photos", "seen_on_sources", "features", "extra", "enriched"]
# Arrival numbers: rows of one chunk stay below 2^32, places inside an array below 2^20, and the product fits.
_CHUNK_SPAN = 1 << 32
_AT_SPAN = 1 << 20


def leaf_value(leaf: str) -> Column:
    value = F.col(SCALAR_LEAVES[leaf])
    return F.nullif(value, F.lit("unknown")) if leaf == "rental_term" else value


def with_ranks(
    rows: DataFrame, order: list[str], hot: HotKeys, key: str = KEY, lead: list[Column] | None = None
) -> DataFrame:
    """Add ``_chunk``, ``_ord`` (arrival number, from 1), ``_rec`` and ``_rank``.

    ``lead`` never falls in arrival order, compared as a whole (default: the order columns).
    """
    part = [key, "_chunk"] if hot else [key]
    if "_chunk" not in rows.columns:
        rows = rows.withColumn("_chunk", _chunk_of(order, hot, lead))
    arrival = Window.partitionBy(*part).orderBy(*order)
    before = arrival.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_ord": F.row_number().over(arrival) + F.col("_chunk").cast("bigint") * F.lit(_CHUNK_SPAN),
            "_top": F.max("source_priority").over(before),
            "_old": F.min("first_seen_at").over(before),
        }
    )
    if hot:
        # One small row per (hot key, chunk). The rows already sit by (key, chunk), so only these move.
        runs = rows.groupBy(key, "_chunk").agg(
            F.max("source_priority").alias("_c_top"), F.min("first_seen_at").alias("_c_old")
        )
        earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carry = runs.select(
            key,
            "_chunk",
            F.max("_c_top").over(earlier).alias("_c_top"),
            F.min("_c_old").over(earlier).alias("_c_old"),
        )
        rows = rows.join(carry, [key, "_chunk"], "left").withColumns(
            {"_top": F.greatest("_top", "_c_top"), "_old": F.least("_old", "_c_old")}
        )
    record = (
        F.col("_top").isNull()
        | (F.col("source_priority") > F.col("_top"))
        | ((F.col("source_priority") == F.col("_top")) & (F.col("first_seen_at") < F.col("_old")))
    )
    return rows.withColumn("_rec", F.coalesce(record, F.lit(False))).withColumn(
        "_rank", F.when(F.col("_rec"), F.col("_ord")).otherwise(-F.col("_ord"))
    )


def _chunk_of(order: list[str], hot: HotKeys, lead: list[Column] | None) -> Column:
    return hot.chunk([F.col(c) for c in order] if lead is None else lead) if hot else F.lit(0)


def dealt_by_key(
    rows: DataFrame, order: list[str], hot: HotKeys, lead: list[Column] | None = None, once: bool = True
) -> tuple[DataFrame, T.StructType]:
    """Rows packed and dealt by key (hot keys by run), ``once`` for all branches of a merge; with the types of the packed columns.

    What ranks are made of stays open: the branches open what they need behind the shuffle.
    """
    rows = rows.withColumn("_chunk", _chunk_of(order, hot, lead))
    packed, kinds = pack(rows, [KEY, *order, "source_priority", "first_seen_at", "_chunk"])
    by = [KEY, "_chunk"] if hot else [KEY]
    return deal(packed, *by) if once else packed.repartition(*by), kinds


def split_by_heat(
    rows: DataFrame, order: list[str], hot: HotKeys | None, build, lead: list[Column] | None = None
) -> DataFrame:
    """Apply ``build(rows, hot)`` once, or to cold and hot keys apart.

    Cold keys keep the one-shuffle plan (window and aggregate share it); hot keys pay for chunks.
    """
    compile_wide_rows(rows.sparkSession)
    if hot is None:
        hot = find_hot_keys(rows, KEY, [F.col(c) for c in order] if lead is None else lead)
    if not hot:
        return build(rows, HotKeys([], []))
    is_hot = hot.is_hot(F.col(KEY))
    return build(rows.filter(~is_hot), HotKeys([], [])).unionByName(build(rows.filter(is_hot), hot))


def scalar_aggregates(leaves: list[str] | None = None) -> list[Column]:
    out = []
    for leaf in leaves or SCALAR_LEAVES:
        value = leaf_value(leaf)
        out.append(F.max_by(value, F.when(value.isNotNull(), F.col("_rank"))).alias(leaf))
    return out


def merge_scalars(ranked: DataFrame, leaves: list[str] | None = None) -> DataFrame:
    """Scalar leaves, authority and dates per key, flat."""
    flat = ranked.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("source", "_rank").alias("source"),
        F.max_by("url", "_rank").alias("url"),
        F.max("source_priority").alias("source_priority"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max("last_seen_at").alias("last_seen_at"),
        *([single_row_photos()] if "photos" in ranked.columns else []),
        *scalar_aggregates(leaves),
    )
    return flat.withColumns(
        {k: F.coalesce(k, F.lit(v)) for k, v in LEAF_DEFAULTS.items() if k in flat.columns}
    )


def _facets(ranked: DataFrame) -> DataFrame:
    """Long form of every collection: one row per photo, map entry, source and array element.

    Two plain explodes; no per-element lambda, so the whole step stays in generated code.
    """
    kinds = [("photo", "photos"), ("listed", "enriched.cross_listed_on"), ("seen", "seen_on_sources")]
    kinds += list(MAP_PARTS.items()) + [("external", "enriched.external_ids")]
    entry = "ARRAY<STRUCT<name: STRING, value: STRING>>"
    parts = []
    for kind, path in kinds:
        is_map = kind in MAP_PARTS or kind == "external"
        members = F.map_entries(path) if is_map else F.arrays_zip(F.col(path).alias("n"), F.col(path).alias("v"))
        parts.append(F.struct(F.lit(kind).alias("kind"), members.cast(entry).alias("members")))
    keyed = ranked.select(KEY, "_rank", "_ord", F.explode(F.array(*parts)).alias("p"))
    filled = keyed.select(KEY, "_rank", "_ord", "p.kind", F.posexplode("p.members").alias("at", "m"))
    return filled.select(KEY, "_rank", "_ord", "kind", "m.name", "m.value", "at")


def merge_collections(ranked: DataFrame) -> DataFrame:
    """Photos, maps and sets per key.

    First one row per (key, kind, name), with partial aggregation, so that copies of one photo or source never
    travel; then one row per key whose arrays hold distinct members only.
    """
    # A present null is a value too, so values travel wrapped. External ids take the latest, not the best.
    turn = F.when(F.col("kind") == "external", F.col("_ord")).otherwise(F.col("_rank"))
    # Copies of a member go first, by numbers alone: those are counted in a hash table, while texts as results need all rows sorted.
    copies = _facets(ranked).groupBy(KEY, "kind", "name", "value").agg(
        F.max(turn).alias("turn"),
        F.max(F.col("_rank") * F.lit(_AT_SPAN) - F.col("at")).alias("place"),
        F.min(F.col("_ord") * F.lit(_AT_SPAN) + F.col("at")).alias("arrived"),
    )
    facts = copies.groupBy(KEY, "kind", "name").agg(
        F.max_by(F.struct("value"), "turn").alias("best"), F.max("place").alias("place"), F.min("arrived").alias("arrived")
    )

    def listed(kind: str, position: Column) -> Column:
        pairs = F.sort_array(
            F.collect_list(F.when(F.col("kind") == kind, F.struct(position.alias("p"), F.col("name").alias("x"))))
        )
        return pairs["x"]

    def mapped(kind: str) -> Column:
        pairs = F.collect_list(
            F.when(F.col("kind") == kind, F.struct(F.col("name").alias("key"), F.col("best.value").alias("value")))
        )
        return F.map_from_entries(F.sort_array(pairs))

    return facts.groupBy(KEY).agg(
        listed("photo", -F.col("place")).alias("photos"),
        listed("listed", F.col("arrived")).alias("cross_listed_on"),
        listed("seen", F.lit(0)).alias("seen_on_sources"),
        mapped("external").alias("external_ids"),
        *[mapped(kind).alias(kind) for kind in MAP_PARTS],
    )


def nest(flat: DataFrame) -> DataFrame:
    """Flat leaves and collections back to the canonical listing schema."""
    return flat.select(*nested_columns(flat))


def nested_columns(flat: DataFrame) -> list[Column]:
    have = set(flat.columns)

    def leaf(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    def group(prefix: str) -> dict[str, Column]:
        return {
            n.split("__")[1]: leaf(n) for n in SCALAR_LEAVES if n.startswith(prefix + "__")
        }

    commute = F.col("commute") if "commute" in have else S.null_of(S.COMMUTE_DDL)
    nested = {
        "id": F.col(KEY),
        "price": S.price_of(**group("price")),
        "location": S.location_of(**group("location")),
        "contact": S.contact_of(**group("contact")),
        "enriched": S.enriched_of(
            external_ids=leaf("external_ids"),
            lister=leaf("lister"),
            cross_listed_on=leaf("cross_listed_on"),
            attrs=leaf("attrs"),
            commute=commute,
        ),
    }
    return [nested.get(n, leaf(n)).cast(ddl).alias(n) for n, ddl in S.LISTING_FIELDS]


def single_row_photos() -> Column:
    """Photos of a row that repeats some, kept because a key seen once is never de-duplicated."""
    repeats = F.size("photos") != F.size(F.array_distinct("photos"))
    return F.max(F.when(repeats, F.col("photos"))).alias("_own_photos")


def merge_listings(
    rows: DataFrame,
    order: list[str],
    hot: HotKeys | None = None,
    flat: bool = False,
    lead: list[Column] | None = None,
    whole: bool = True,
) -> DataFrame:
    """One merged listing per canonical key.

    ``rows`` are raw listings with stamps (``canonical_key``, ``source_priority``, ``first_seen_at``,
    ``last_seen_at``, ``seen_on_sources``); ``order`` names the arrival columns, of any type that sorts. Rows move once, with all that
    a listing is made of. If some of it may not be asked for (not ``whole``), scalars and collections move apart, and only if they are.
    """

    plain = ["source", "url", "last_seen_at", "photos", *dict.fromkeys(p.split(".")[0] for p in SCALAR_LEAVES.values())]
    # Commute is no fact that a merge carries.
    members = [*_COLLECTIONS[:-1], F.col("enriched").dropFields("commute").alias("enriched")]

    def build(part: DataFrame, heat: HotKeys) -> DataFrame:
        def ranked(*columns) -> tuple[DataFrame, T.StructType]:
            slim = part.select(KEY, *order, "source_priority", "first_seen_at", *columns)
            ready, kinds = dealt_by_key(slim, order, heat, lead, once=whole)
            return with_ranks(ready, order, heat, lead=lead), kinds

        if whole:
            every, kinds = ranked(*[c for c in plain if c != "photos"], *members)
            scalars, listed = unpack(every, kinds, plain), unpack(every, kinds, _COLLECTIONS)
        else:
            scalars, listed = (unpack(*ranked(*columns)) for columns in (plain, members))
        merged = merge_scalars(scalars).join(merge_collections(listed), KEY, "left")
        photos = F.when((F.col("_n") == 1) & F.col("_own_photos").isNotNull(), F.col("_own_photos"))
        return merged.withColumn("photos", F.coalesce(photos, "photos", F.array().cast("ARRAY<STRING>")))

    merged = split_by_heat(rows, order, hot, build, lead)
    return merged if flat else nest(merged)


# --- per-arrival versions -------------------------------------------------------------------------------

_MEMBER = "STRUCT<kind: STRING, name: STRING, value: STRING>"


def _new_members(ranked: DataFrame) -> DataFrame:
    """(key, _ord) of rows that bring a collection member not seen before, with the members (``_fresh``)."""
    firsts = (
        _facets(ranked)
        .filter("kind <> 'external'")
        .groupBy(KEY, "kind", "name")
        .agg(F.min_by(F.struct("_ord", "value"), "_ord").alias("first"))
    )
    member = F.struct("kind", "name", F.col("first.value").alias("value"))
    return firsts.groupBy(KEY, F.col("first._ord").alias("_ord")).agg(F.collect_list(member).alias("_fresh"))


def _changed_ids(ranked: DataFrame, heat: HotKeys) -> DataFrame:
    """(key, _ord) of rows whose portal id differs from the one their source had before."""
    ids = ranked.select(
        KEY, "_chunk", "_ord", F.explode("enriched.external_ids").alias("name", "value")
    )
    inside = Window.partitionBy(KEY, "_chunk", "name").orderBy("_ord")
    ids = ids.withColumn("_was", F.lag("value").over(inside))
    if heat:
        runs = ids.groupBy(KEY, "_chunk", "name").agg(F.max_by("value", "_ord").alias("_last"))
        earlier = Window.partitionBy(KEY, "name").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carry = runs.select(KEY, "_chunk", "name", F.last("_last").over(earlier).alias("_carried"))
        ids = ids.join(carry, [KEY, "_chunk", "name"], "left").withColumn("_was", F.coalesce("_was", "_carried"))
    differs = ids.filter(~F.col("_was").eqNullSafe(F.col("value")))
    return differs.select(KEY, "_ord").distinct().withColumn("_new_id", F.lit(True))


def merge_history(
    rows: DataFrame,
    order: list[str],
    leaves: list[str] | None = None,
    hot: HotKeys | None = None,
    lead: list[Column] | None = None,
    collections: bool = False,
) -> DataFrame:
    """The merged state after each arrival: input columns plus ``v_<leaf>`` for each leaf, ``v_source``,
    ``v_url``, ``v_priority``, ``v_first_seen``, and the flags ``is_new`` and ``changed``; with ``collections``
    also ``v_photos``, ``v_seen_on_sources`` and the open maps.

    A record always changes the row (priority rises or the date falls). Any other row does when it fills a leaf,
    lowers the first-seen date, brings a member (not a null one) no earlier row had, or renews its source's portal id.
    """
    names = list(leaves or SCALAR_LEAVES)
    # The marks of a row are joined to it where its key's rows already sit, so wide rows move once.
    join_in_place(rows.sparkSession)

    def build(part: DataFrame, heat: HotKeys) -> DataFrame:
        dealt, kinds = dealt_by_key(part, order, heat, lead)
        ranked = with_ranks(dealt, order, heat, lead=lead)
        scope = [KEY, "_chunk"] if heat else [KEY]
        members = unpack(ranked, kinds, _COLLECTIONS)
        arrived = unpack(ranked, kinds).join(_new_members(members), [KEY, "_ord"], "left").join(
            _changed_ids(members, heat), [KEY, "_ord"], "left"
        )
        upto = Window.partitionBy(*scope).orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0)

        def carried(leaf: str) -> Column:
            value = leaf_value(leaf)
            return F.max(F.when(value.isNotNull(), F.struct("_rank", value.alias("x"))))

        state = {f"_s_{n}": carried(n) for n in names}
        state["_s_auth"] = F.max(F.when(F.col("_rec"), F.struct("_rank", "source", "url")))
        lists: dict[str, Column] = {}
        if collections:
            arrived = arrived.withColumn("_own", _row_members())
            none = F.array().cast(f"ARRAY<{_MEMBER}>")
            fresh = F.coalesce("_fresh", none)
            of_kind = lambda c, keep: F.filter(c, lambda m: (m["kind"] == "photo") == keep)
            no_photos = F.array().cast("ARRAY<STRING>")
            unseen = F.transform(of_kind(fresh, True), lambda m: m["name"])
            added = F.array_intersect(F.coalesce("photos", no_photos), unseen)
            # Only rows that add something enter the lists, so they grow with the state, not with the rows.
            brought = F.nullif(of_kind(F.when(F.col("_rec"), F.col("_own")).otherwise(fresh), False), none)
            lists = {
                "_l_top": F.collect_list(F.when(F.col("_rec"), F.nullif(F.col("photos"), no_photos))),
                "_l_more": F.collect_list(F.when(~F.col("_rec"), F.nullif(added, no_photos))),
                "_l_maps": F.collect_list(brought),
            }
        held = arrived.withColumns(
            {k: v.over(upto) for k, v in (state | lists).items()}
            | {
                "v_priority": F.greatest("_top", "source_priority"),
                "v_first_seen": F.least("_old", "first_seen_at"),
            }
        )
        if heat:
            runs = arrived.groupBy(KEY, "_chunk").agg(*[v.alias("c" + k) for k, v in (state | lists).items()])
            earlier = Window.partitionBy(KEY).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
            past = [F.max("c" + k).over(earlier).alias("c" + k) for k in state]
            past += [F.flatten(F.collect_list("c" + k).over(earlier)).alias("c" + k) for k in lists]
            held = held.join(runs.select(KEY, "_chunk", *past), [KEY, "_chunk"], "left").withColumns(
                {k: F.greatest(k, "c" + k) for k in state} | {k: F.concat(F.coalesce("c" + k, F.slice(k, 1, 0)), k) for k in lists}
            )
        filled = reduce(
            lambda a, b: a | b,
            [F.coalesce(F.col(f"_s_{n}._rank") == F.col("_rank"), F.lit(False)) for n in names],
        )
        is_new = F.col("_top").isNull()
        moved = (
            F.col("_rec")
            | filled
            | F.coalesce(F.col("first_seen_at") < F.col("_old"), F.lit(False))
            | F.coalesce(F.exists("_fresh", lambda m: m["value"].isNotNull()), F.lit(False))
            | F.coalesce("_new_id", F.lit(False))
        )
        out = {"v_" + n: F.col(f"_s_{n}.x") for n in names}
        for leaf, value in LEAF_DEFAULTS.items():
            if "v_" + leaf in out:
                out["v_" + leaf] = F.coalesce(out["v_" + leaf], F.lit(value))
        out |= {"v_source": F.col("_s_auth.source"), "v_url": F.col("_s_auth.url"), "is_new": is_new, "changed": moved}
        if collections:
            union = F.array_distinct(F.concat(F.flatten(F.reverse("_l_top")), F.flatten("_l_more")))
            out["v_photos"] = F.when(is_new, F.coalesce("photos", union)).otherwise(union)
            out |= {"v_" + kind: _last_values("_l_maps", kind) for kind in MAP_PARTS}
            out["v_seen_on_sources"] = F.array_sort(
                F.transform(F.filter(F.flatten("_l_maps"), lambda m: m["kind"] == "seen"), lambda m: m["name"])
            )
            out["v_seen_on_sources"] = F.array_distinct(out["v_seen_on_sources"])
        scratch = [*state, *lists, *["c" + k for k in (state | lists)]]
        return held.withColumns(out).drop(
            *scratch, "_top", "_old", "_c_top", "_c_old", "_chunk", "_fresh", "_new_id", "_own"
        )

    return split_by_heat(rows, order, hot, build, lead)


def _row_members() -> Column:
    """A row's own photos, map entries and sources as members."""

    def member(kind: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("string").alias("value"))

    def of_array(kind: str, path: str) -> Column:
        return F.transform(F.col(path), lambda x: member(kind, x, F.lit(None)))

    def of_map(kind: str, path: str) -> Column:
        return F.transform(F.map_entries(path), lambda e: member(kind, e["key"], e["value"]))

    parts = [of_array("photo", "photos"), of_array("seen", "seen_on_sources")]
    parts += [of_map(kind, path) for kind, path in MAP_PARTS.items()]
    none = F.array().cast(f"ARRAY<{_MEMBER}>")
    return F.concat(*[F.coalesce(p, none) for p in parts])


def _last_values(lists: str, kind: str) -> Column:
    """Map of the members of one kind, the last value of each name."""
    members = F.filter(F.flatten(lists), lambda m: m["kind"] == kind)
    later = F.aggregate(
        members,
        F.create_map().cast("MAP<STRING, STRING>"),
        lambda acc, m: F.map_concat(
            F.map_filter(acc, lambda k, _: k != m["name"]), F.map_from_entries(F.array(F.struct(m["name"], m["value"])))
        ),
    )
    return F.when(F.size(members) > 0, later)
