"""M - keyed state kept by bulk updates and event logs.

Each operator is a pure function (state, events, params) -> new state.  An UPDATE
of the reference becomes a left join plus a projection, a DELETE an anti join, an
INSERT a union; the result is a new snapshot.  An UPDATE ... FROM applies once per
target row however many rows match, so matches are reduced to distinct keys first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.joins import by_hash
from tessera.functions.num import epoch_micros
from tessera.functions.ranking import add_prefix_sums, number_rows, with_bucket
from tessera.operators import spatial
from tessera.params import StateParams

FIXED_POINT = 1_000_000_000  # running positions accumulate in 1e-9 units


def latest_action(actions: DataFrame, key: str = "key") -> DataFrame:
    """One current action per key, last (ts, seq) wins.  Partial aggregation keeps
    a hot key cheap: each task reduces its share before the shuffle."""
    best = F.max_by(F.struct("action", "ts", "seq"), F.struct("ts", "seq"))
    return actions.groupBy(key).agg(best.alias("b")).select(key, "b.action", "b.ts", "b.seq")


def _inputs(latest: DataFrame, *acts: str) -> DataFrame:
    return (latest.filter(F.col("action").isin(*acts))
            .select(F.col("key").alias("id"), F.col("action").alias("act")))


def moves(actors: DataFrame, latest: DataFrame, grid: DataFrame, sp: StateParams = StateParams()) -> DataFrame:
    """'w' steps forward, 's' back by move_speed along dir; a step is kept only when
    it lands on an existing, non-blocking cell."""
    fwd = F.col("act") == "w"
    c, s, v = F.cos("dir"), F.sin("dir"), F.lit(sp.move_speed)
    prop = actors.select("id", "x", "y", "dir").join(_inputs(latest, "w", "s"), "id").select(
        "id", F.when(fwd, F.col("x") + c * v).otherwise(F.col("x") - c * v).alias("x"),
        F.when(fwd, F.col("y") + s * v).otherwise(F.col("y") - s * v).alias("y"))
    ok = spatial.cell_lookup(prop, grid).select(
        "id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    return (actors.join(ok, "id", "left")
            .withColumns({"x": F.coalesce("nx", "x"), "y": F.coalesce("ny", "y")})
            .drop("nx", "ny"))


def turns(actors: DataFrame, latest: DataFrame, sp: StateParams = StateParams()) -> DataFrame:
    """'a' turns left (dir - turn_speed), 'd' right; dir is never normalised."""
    j = actors.join(_inputs(latest, "a", "d"), "id", "left")
    d = (F.when(F.col("act") == "a", F.col("dir") - F.lit(sp.turn_speed))
         .when(F.col("act") == "d", F.col("dir") + F.lit(sp.turn_speed)).otherwise(F.col("dir")))
    return j.withColumn("dir", d).drop("act")


def spawn(actors: DataFrame, latest: DataFrame, sp: StateParams = StateParams(),
          stamp_id: int = 3) -> DataFrame:
    """A projectile for every actor shooting ('x') with ammo left (ammo before
    ``consume_quota``)."""
    return (actors.filter(F.col("ammo") > 0).join(_inputs(latest, "x"), "id")
            .select(F.col("id").alias("owner"), "x", "y", "dir",
                    F.lit("bullet").alias("kind"), F.lit(None).cast("string").alias("name"),
                    F.lit(stamp_id).alias("stamp_id"), F.lit("*").alias("icon"),
                    F.lit(sp.projectile_size).alias("world_w"),
                    F.lit(sp.projectile_size).alias("world_h")))


def assign_ids(new_rows: DataFrame, order: list[str], base: Column) -> DataFrame:
    """Surrogate ids base + rank in ``order`` (repeatable for a unique order)."""
    return number_rows(new_rows, order, out="_rn").withColumn(
        "id", (base + F.col("_rn")).cast("long")).drop("_rn")


def consume_quota(actors: DataFrame, latest: DataFrame) -> DataFrame:
    j = actors.join(_inputs(latest, "x"), "id", "left")
    spend = (F.col("act") == "x") & (F.col("ammo") > 0)
    return j.withColumn("ammo", F.when(spend, F.col("ammo") - 1).otherwise(F.col("ammo"))).drop("act")


def advance(points: DataFrame, speed: float) -> DataFrame:
    return points.withColumns({"x": F.col("x") + F.cos("dir") * F.lit(speed),
                               "y": F.col("y") + F.sin("dir") * F.lit(speed)})


def _differs(low: str, high: str, key: str) -> Column:
    """Whether a set given by its smallest and largest member has another one than ``key``
    (false for an empty set or a NULL key)."""
    return F.coalesce((F.col(low) != F.col(key)) | (F.col(high) != F.col(key)), F.lit(False))


def cell_shots(actors: DataFrame, projectiles: DataFrame, damage: int) -> DataFrame:
    """What ``cell_hits`` looks up: per cell with an actor (``_k`` 0, ``_k1``, ``_k2``) the smallest
    and largest owner ``_lo``, ``_hi`` of the projectiles in it, and per owner (``_k`` 1, ``_k1``)
    ``_win``, if one of its projectiles is in the cell of another actor with at most ``damage`` hp.

    Projectiles in no actor's cell are dropped by the join, before any aggregate, and an owner
    gets a row only where it wins: a task's map holds cells and owners that actors look up,
    however many projectiles it reads."""
    weak = F.when(F.col("hp") <= damage, F.col("id"))
    cells = (spatial.with_cell(actors).groupBy(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
             .agg(F.min(weak).alias("_lo"), F.max(weak).alias("_hi")))
    p = spatial.with_cell(projectiles).filter("owner is not null").select("cx", "cy", "owner")
    p = _with_cells(p, cells, "inner").select("cx", "cy", "owner", _differs("_lo", "_hi", "owner").alias("win"))
    cell, owner = _hit_keys("owner")
    return (p.select(F.inline(F.when(F.col("win"), F.array(cell, owner)).otherwise(F.array(cell))), "owner", "win")
            .groupBy(F.col("k").alias("_k"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
            .agg(F.min("owner").alias("_lo"), F.max("owner").alias("_hi"), F.max("win").alias("_win")))


def _hit_keys(key: str) -> tuple[Column, Column]:
    """The key of a row's cell and that of its actor."""
    return (F.struct(F.lit(0).alias("k"), F.col("cx").alias("k1"), F.col("cy").alias("k2")),
            F.struct(F.lit(1).alias("k"), F.col(key).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")))


def cell_hits(actors: DataFrame, projectiles: DataFrame, damage: int) -> DataFrame:
    """(id, hit, win) per actor: whether a projectile of another owner is in its cell, and
    whether one of its own projectiles is in the cell of another actor whose hp is at 0 or
    below after this batch's damage.

    No projectile x actor pairs: of a cell only the smallest and the largest owner matter to
    an actor, and to a projectile the smallest and largest actor with at most ``damage`` hp
    (the projectile itself hits it).  Projectiles are read once: each in an actor's cell gives a
    row keyed by its cell, and if it wins one keyed by its owner, to one aggregate
    (``cell_shots``), and actors look up both.  All are partial aggregates, so a cell or an
    owner with a third of all rows is no group in one task, and the join to its one row can
    be split.  A NULL owner never hits."""
    shots = cell_shots(actors, projectiles, damage)
    a = spatial.with_cell(actors).select("cx", "cy", "id").select(F.inline(F.array(*_hit_keys("id"))), "id")
    j = a.join(shots, F.expr("k = _k AND k1 = _k1 AND k2 = _k2"), "left")
    cell_row = F.col("k") == 0
    return j.groupBy("id").agg(F.max(cell_row & _differs("_lo", "_hi", "id")).alias("hit"),
                               F.max(~cell_row & F.coalesce("_win", F.lit(False))).alias("win"))


def _extremes(rows: DataFrame, key: str) -> DataFrame:
    """(_cx, _cy, _lo, _hi): smallest and largest ``key`` of a cell."""
    return rows.groupBy(F.col("cx").alias("_cx"), F.col("cy").alias("_cy")).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))


def _with_cells(rows: DataFrame, cells: DataFrame, how: str = "left") -> DataFrame:
    """``cells``: one row per cell, hashed; the rows are many and pass by unsorted."""
    return rows.join(by_hash(cells), (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")), how)


def apply_hits(actors: DataFrame, hits: DataFrame, damage: int) -> DataFrame:
    """Every actor hit at least once in the batch loses ``damage`` once; an owner scores +1
    once if any of its victims ends at hp <= 0.  ``hits``: rows of ``cell_hits``."""
    flags = hits.select(F.col("id").alias("_id"), "hit", "win")
    j = actors.join(flags, F.col("id") == F.col("_id"), "left")
    return (j.withColumns({"hp": F.when(F.col("hit"), F.col("hp") - damage).otherwise(F.col("hp")),
                           "score": F.when(F.col("win"), F.col("score") + 1).otherwise(F.col("score"))})
            .drop("_id", "hit", "win"))


def expire_hits(projectiles: DataFrame, actors: DataFrame) -> DataFrame:
    """Projectiles that are in no other actor's cell stay.  An actor's cell is one row with
    its smallest and largest id; a projectile without an owner never hits and stays."""
    j = _with_cells(spatial.with_cell(projectiles), _extremes(spatial.with_cell(actors), "id"))
    return j.filter(~_differs("_lo", "_hi", "owner")).select(*projectiles.columns)


def respawn_cell(grid: DataFrame, seed: int) -> Column:
    """The one respawn cell of a batch: smallest (x*7919 + y*6101 + seed) % 10007 over
    the 'R' cells, ties by (x, y).  A scalar subquery (partial aggregation)."""
    r = grid.filter(F.col("tile") == "R")
    key = (F.col("x") * 7919 + F.col("y") * 6101 + seed) % 10007
    return r.agg(F.min_by(F.struct("x", "y"), F.struct(key, "x", "y"))).scalar()


def respawn(actors: DataFrame, grid: DataFrame, seed: int) -> DataFrame:
    """All actors at hp <= 0 move to the batch's single respawn cell, dir 0."""
    spot = respawn_cell(grid, seed)
    dead = F.col("hp") <= 0
    return actors.withColumns({
        "x": F.when(dead, spot.getField("x").cast("double")).otherwise(F.col("x")),
        "y": F.when(dead, spot.getField("y").cast("double")).otherwise(F.col("y")),
        "dir": F.when(dead, F.lit(0.0)).otherwise(F.col("dir")),
    })


def reset(actors: DataFrame, sp: StateParams = StateParams()) -> DataFrame:
    dead = F.col("hp") <= 0
    return actors.withColumns({"hp": F.when(dead, F.lit(sp.hp_full)).otherwise(F.col("hp")),
                               "ammo": F.when(dead, F.lit(sp.ammo_max)).otherwise(F.col("ammo"))})


def refill(actors: DataFrame, now: float, interval_s: int, ammo_max: int) -> DataFrame:
    """Token refill: steps = floor((now - last) / interval); when the quota is not
    full and steps > 0, ammo = clamp(ammo + steps) and last = round(now).  ``last``
    does not move while full."""
    steps = F.floor((F.lit(now) - F.col("last_refill")) / F.lit(interval_s))
    go = (F.col("ammo") != ammo_max) & (steps > 0)
    now_s = int(now + 0.5) if now >= 0 else -int(-now + 0.5)
    return actors.withColumns({
        "ammo": F.when(go, F.greatest(F.lit(0), F.least(F.lit(ammo_max), F.col("ammo") + steps)).cast("int"))
                 .otherwise(F.col("ammo")),
        "last_refill": F.when(go, F.lit(now_s).cast("long")).otherwise(F.col("last_refill")),
    })


def pending_actions(actions: DataFrame, offsets: DataFrame) -> DataFrame:
    """Actions not yet consumed: seq beyond the key's consumed-up-to offset
    (keys without an offset keep everything).  Replaces blanking the input table."""
    off = offsets.select("key", F.col("seq").alias("_off"))
    return (actions.join(off, "key", "left")
            .filter(F.col("_off").isNull() | (F.col("seq") > F.col("_off"))).drop("_off"))


def get_or_create(entities: DataFrame, names: DataFrame, sp: StateParams = StateParams()) -> DataFrame:
    """(name, id, created, x, y, dir, kind, stamp_id, icon, hp, ammo, score): every
    requested (name, icon) is looked up (the smallest id when a name repeats); the missing
    ones are created on the spawn cell with full hp and ammo and ids after the current
    maximum.  A name requested with several icons is created with the smallest."""
    cols = ["x", "y", "dir", "kind", "stamp_id", "icon", "hp", "ammo", "score"]
    existing = entities.groupBy("name").agg(F.min_by(F.struct("id", *cols), "id").alias("e")).select("name", "e.*")
    req = names.groupBy("name").agg(F.min("icon").alias("want"))
    found = req.join(existing, "name").select("name", "id", F.lit(False).alias("created"), *cols)
    base = entities.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new = assign_ids(req.join(existing, "name", "left_anti"), ["name"], base)
    new = new.select("name", "id", F.lit(True).alias("created"), F.lit(sp.spawn_x).alias("x"), F.lit(sp.spawn_y).alias("y"),
                     F.lit(sp.spawn_dir).alias("dir"), F.lit("player").alias("kind"), F.lit(0).alias("stamp_id"),
                     F.col("want").alias("icon"), F.lit(sp.hp_full).alias("hp"), F.lit(sp.ammo_max).alias("ammo"),
                     F.lit(0).alias("score"))
    return found.unionByName(new)


def pk_violations(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    return (df.groupBy(*cols).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
            .select(F.lit(name).alias("check"), F.concat_ws(":", *[F.col(c).cast("string") for c in cols]).alias("key"),
                    "n"))


def not_null_violations(df: DataFrame, cols: list[str], key: list[str], name: str) -> DataFrame:
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    return (df.filter(bad).groupBy(*key).agg(F.count("*").alias("n"))
            .select(F.lit(name).alias("check"), F.concat_ws(":", *[F.col(c).cast("string") for c in key]).alias("key"),
                    "n"))


def fk_violations(child: DataFrame, child_cols: list[str], parent: DataFrame,
                  parent_cols: list[str], name: str) -> DataFrame:
    p = parent.select(*[F.col(a).alias(b) for a, b in zip(parent_cols, child_cols)])
    orphans = child.join(p, child_cols, "left_anti")
    for c in child_cols:
        orphans = orphans.filter(F.col(c).isNotNull())
    return (orphans.groupBy(*child_cols).agg(F.count("*").alias("n"))
            .select(F.lit(name).alias("check"),
                    F.concat_ws(":", *[F.col(c).cast("string") for c in child_cols]).alias("key"), "n"))


def keyed_state(actors: DataFrame, ids: DataFrame) -> DataFrame:
    return actors.join(ids.select("id").distinct(), "id", "left_semi").select("id", "name", "x", "y", "dir")


def trajectory(starts: DataFrame, actions: DataFrame, sp: StateParams = StateParams(), bucket_s: int = 3600) -> DataFrame:
    """Per key, replay an action log without walls: dir = dir0 + turn_speed * (net
    right turns so far); each 'w'/'s' moves by move_speed along the dir of that
    moment.  Two stacked running sums, both split by time bucket (``ranking``) and both
    on the one exchange by (key, bucket); each step is rounded to 1e-9, so the split is
    exact and n steps are within n * 0.5e-9 of the unrounded sum.  A key without a start
    begins at the spawn point."""
    st = starts.select(F.col("id").alias("_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("dir").alias("dir0"))
    a = actions.select("key", "ts", "seq", "action").join(st, F.col("key") == F.col("_id"), "left").select(
        "key", "ts", "seq", "action", F.coalesce("x0", F.lit(sp.spawn_x)).alias("x0"),
        F.coalesce("y0", F.lit(sp.spawn_y)).alias("y0"), F.coalesce("dir0", F.lit(sp.spawn_dir)).alias("dir0"))
    order = ["ts", "seq"]
    a = with_bucket(a, "key", F.floor(epoch_micros("ts") / (bucket_s * 1_000_000)))
    turn = F.when(F.col("action") == "d", 1).when(F.col("action") == "a", -1).otherwise(0).cast("long")
    t = add_prefix_sums(a, order, {"net_turn": turn})
    t = t.withColumn("dir", F.col("dir0") + F.col("net_turn") * F.lit(sp.turn_speed))
    sign = F.when(F.col("action") == "w", 1.0).when(F.col("action") == "s", -1.0).otherwise(0.0)
    fx = F.round(sign * F.cos("dir") * F.lit(sp.move_speed) * FIXED_POINT).cast("long")
    fy = F.round(sign * F.sin("dir") * F.lit(sp.move_speed) * FIXED_POINT).cast("long")
    m = add_prefix_sums(t, order, {"sx": fx, "sy": fy})
    return m.select("key", "ts", "seq", "action", "dir",
                    (F.col("x0") + F.col("sx") / F.lit(float(FIXED_POINT))).alias("x"),
                    (F.col("y0") + F.col("sy") / F.lit(float(FIXED_POINT))).alias("y"))


REFILL_SCHEMA = "key long, us long, seq long, k int"


def round_second(us: int) -> int:
    return (us + 500_000) // 1_000_000 * 1_000_000


def _refill_fold(capacity: int, interval_us: int):
    """Seconds of each key (sorted by key and second) -> its refills.

    ``last`` is a whole second and the interval is at least one, so either every event of a
    second is late enough for a refill or none is, and a second has one refill at most: at
    its first event, or, with a full bucket, at its first spending event.  The state
    carried from second to second (and from batch to batch) is three numbers.  The loop goes
    from refill to refill: what lies between is a binary search and a difference of sums."""
    def of_key(c, state, out):
        started, k, used, last = state
        sec, spent = c["sec"], np.concatenate([[0], np.cumsum(c["n"])])
        if not started:
            k, used, last = capacity, 0, round_second(int(c["us"][0]))
        i, m = 0, len(sec)
        while i < m:
            late = max(i, int(np.searchsorted(sec, -(-(last + interval_us) // 1_000_000))))
            used += int(spent[late] - spent[i])
            if late == m:
                break
            i, tokens, n = late, max(0, k - used), int(c["n"][late])
            if tokens == capacity and not n:
                # full and nothing spent: the clock stands up to the next second with a shot
                i = int(np.searchsorted(spent, spent[i] + 1)) - 1
                continue
            us, seq, after = int(c["us"][i]), c["seq"][i], n
            if c["x"][i]:
                tokens, after = max(0, tokens - 1), n - 1
            elif tokens == capacity:
                tokens, us, seq, after = capacity - 1, int(c["sus"][i]), c["sseq"][i], n - 1
            k = min(capacity, tokens + (us - last) // interval_us)
            last, used = round_second(us), after
            out.append((us, seq, k))
            i += 1
        return True, k, used, last

    def run(batches):
        cur, state = None, (False, capacity, 0, 0)
        for b in batches:
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("sec", "us", "x", "n")}
            c["sus"] = b.column("sus").fill_null(0).to_numpy()          # null without a shot
            keys, seqs = b.column("key").to_pylist(), {n: b.column(n).to_pylist() for n in ("seq", "sseq")}
            rows, at = [], 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if not (state[0] and keys[at] == cur):
                    cur, state = keys[at], (False, capacity, 0, 0)
                part = {n: v[at:end] for n, v in {**c, **seqs}.items()}
                found = []
                state = of_key(part, state, found)
                rows += [(cur, *f) for f in found]
                at = end
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))],
                                                 ["key", "us", "seq", "k"])
    return run


def token_bucket(actions: DataFrame, capacity: int, interval_s: int, bucket_s: int = 86_400) -> DataFrame:
    """Per event: allowed (a shot 'x' with a token left spends it) and tokens left
    after the event's refill.  Order per event as in the reference tick: spend,
    then refill (steps = floor((t - last) / interval) whole intervals since the last
    refill, clamp to capacity, last = t rounded to the second; no refill while full).
    A key starts full with last = its first event.  capacity >= 1, interval_s >= 1.

    The clamp makes the chain of refills sequential, but between two refills the tokens are
    max(0, k - shots since then).  So events are reduced to one row per (key, second) before
    the exchange, and only these are folded in order, which bounds a hot key by its
    seconds, not its events.  Every event then finds its last refill and its shot count
    by running values inside (key, day) and carried over days, so a hot key is spread.

    A NULL key is a key of its own; an event without a time spends nothing and has NULL
    tokens."""
    cap, iv = int(capacity), int(interval_s) * 1_000_000
    is_x = F.coalesce(F.col("action") == "x", F.lit(False))
    e = actions.filter("ts is not null").select("key", "seq", "ts", "action", epoch_micros("ts").alias("us"), is_x.alias("x"))
    at = F.struct("us", "seq", "x")
    seconds = (e.groupBy("key", F.floor(F.col("us") / 1_000_000).alias("sec"))
               .agg(F.min(at).alias("a"), F.min(F.when(F.col("x"), at)).alias("s"), F.count_if("x").alias("n"))
               .select("key", "sec", "a.us", "a.seq", "a.x", F.col("s.us").alias("sus"), F.col("s.seq").alias("sseq"), "n"))
    refills = seconds.repartition("key").sortWithinPartitions("key", "sec").mapInArrow(_refill_fold(cap, iv), REFILL_SCHEMA)

    u = (e.withColumns({"k": F.lit(None).cast("int"), "_side": F.lit(0)})
         .unionByName(refills.withColumns({"x": F.lit(False), "_side": F.lit(1)}), allowMissingColumns=True))
    u = with_bucket(u, "key", F.floor(F.col("us") / (bucket_s * 1_000_000)))
    order = Window.partitionBy("_k", "_b").orderBy("us", "seq", "_side")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    one = F.when(F.col("x"), 1).otherwise(0)
    u = u.withColumns({"_n": F.sum(one).over(so_far), "_next": F.lead(F.struct("_side", "us", "seq", "k")).over(order)})
    mine = F.when(F.col("_side") == 1, F.struct("k", "_n"))
    u = u.withColumn("_r", F.last(mine, ignorenulls=True).over(so_far))
    days = u.groupBy("_k", "_b").agg(F.sum(one).alias("_t"), F.max(F.when(F.col("_side") == 1, F.struct("us", "seq", "k", "_n"))).alias("_l"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    known = F.when(F.col("_l").isNotNull(), F.struct(F.col("_l.k").alias("k"), (F.col("_l._n") + F.col("_o")).alias("n")))
    days = days.withColumn("_p", F.last(known, ignorenulls=True).over(before)).select(
        F.col("_k").alias("_k2"), F.col("_b").alias("_b2"), "_o", "_p")
    j = u.filter("_side = 0").join(days, (F.col("_k") == F.col("_k2")) & (F.col("_b") == F.col("_b2")))
    k = F.coalesce("_r.k", "_p.k", F.lit(cap))
    since = F.col("_n") + F.col("_o") - one - F.coalesce(F.col("_r._n") + F.col("_o"), "_p.n", F.lit(0))
    j = j.withColumn("_have", F.greatest(F.lit(0), k - since))
    allowed = F.when(F.col("x") & (F.col("_have") > 0), 1).otherwise(0)
    refill = (F.col("_next._side") == 1) & (F.col("_next.us") == F.col("us")) & F.col("_next.seq").eqNullSafe(F.col("seq"))
    out = j.select("key", "seq", "ts", "action", allowed.cast("int").alias("allowed"),
                   F.when(refill, F.col("_next.k")).otherwise(F.col("_have") - allowed).cast("int").alias("tokens"))
    timeless = actions.filter("ts is null").select("key", "seq", "ts", "action", F.lit(0).alias("allowed"),
                                                   F.lit(None).cast("int").alias("tokens"))
    return out.unionByName(timeless)
