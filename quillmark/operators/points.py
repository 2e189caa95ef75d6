"""Point clouds in long form (cloud_id, pt, x, y, z) and the bodies they are sampled from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.common import release, written
from quillmark.functions import maths
from quillmark.operators.pairs import draw

XYZ = ("x", "y", "z")


def normalized(clouds: DataFrame, eps: float = 0.0) -> DataFrame:
    """VP7: centred, and scaled by the largest distance from the centre (plus eps); a cloud of one place has null scale at eps 0."""
    centre = clouds.groupBy("cloud_id").agg(*[F.avg(c).alias(f"m{c}") for c in XYZ])
    moved = clouds.join(centre, "cloud_id").withColumns({c: F.col(c) - F.col(f"m{c}") for c in XYZ}).drop(*[f"m{c}" for c in XYZ])
    size = moved.groupBy("cloud_id").agg(F.max(F.sqrt(sum((F.col(c) * F.col(c) for c in XYZ), F.lit(0.0)))).alias("scale"))
    return moved.join(size, "cloud_id").withColumns({c: F.try_divide(F.col(c), F.col("scale") + eps) for c in XYZ})


def robust_frame(clouds: DataFrame) -> DataFrame:
    """AG19, MF20: median centre and the 95th percentile of distances from it."""
    centre = clouds.groupBy("cloud_id").agg(*[F.median(c).alias(f"m{c}") for c in XYZ])
    away = F.sqrt(sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in XYZ), F.lit(0.0)))
    return clouds.join(centre, "cloud_id").groupBy("cloud_id", "mx", "my", "mz").agg(F.percentile(away, 0.95).alias("radius"))


def oriented_boxes(clouds: DataFrame) -> DataFrame:
    """MF20: (cloud_id, cx, cy, cz, extent) of each cloud's box along its principal axes: the centre, and the lengths of its sides, greatest first.

    Covariances are partial aggregates, so no cloud is gathered; axes come from Jacobi turns of one 3 x 3 matrix a cloud.
    Axes are those of all points; a cloud without extent in a direction has a side of 0.
    """
    pairs = [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    stats = clouds.groupBy("cloud_id").agg(*[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.covar_pop(a, b).alias(a + b) for a, b in pairs])
    matrix = F.array(*[F.col(min(a, b) + max(a, b)) for a in XYZ for b in XYZ])
    axes = stats.withColumn("v", maths.jacobi(matrix, 3)["v"]).select("cloud_id", *[f"m{c}" for c in XYZ], "v")
    along = [sum(((F.col(c) - F.col(f"m{c}")) * F.col("v")[3 * i + a] for i, c in enumerate(XYZ)), F.lit(0.0)) for a in range(3)]
    ends = clouds.join(axes, "cloud_id").groupBy("cloud_id").agg(*[f(e).alias(f"{n}{a}") for a, e in enumerate(along) for n, f in (("low", F.min), ("high", F.max))])
    mid = [(F.col(f"low{a}") + F.col(f"high{a}")) / 2 for a in range(3)]
    centre = [(F.col(f"m{c}") + sum((mid[a] * F.col("v")[3 * i + a] for a in range(3)), F.lit(0.0))).alias(f"c{c}") for i, c in enumerate(XYZ)]
    sides = F.sort_array(F.array(*[F.col(f"high{a}") - F.col(f"low{a}") for a in range(3)]), asc=False)
    return ends.join(axes, "cloud_id").select("cloud_id", *centre, sides.alias("extent"))


def camera_places(clouds: DataFrame, direction: tuple[float, float, float], fov_degrees: float = 60.0, slack: float = 1.5) -> DataFrame:
    """MF20: (cloud_id, distance, x, y, z): a camera that looks at a cloud's oriented box from a direction, far enough for its longest side."""
    norm = math.sqrt(sum(c * c for c in direction))
    if norm == 0:
        raise ValueError("a camera looks along a direction, not along nothing")
    away = F.col("extent")[0] / 2 / math.tan(math.radians(fov_degrees) / 2) * slack
    boxes = oriented_boxes(clouds).withColumn("distance", away)
    return boxes.select("cloud_id", "distance", *[(F.col(f"c{c}") + d / norm * F.col("distance")).alias(c) for c, d in zip(XYZ, direction, strict=True)])


def cropped(clouds: DataFrame, at: tuple[float, float, float], n: int) -> DataFrame:
    """VP9: each cloud without the n points nearest to a place."""
    away = F.round(sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(XYZ, at, strict=True)), F.lit(0.0)), 9)
    rank = F.row_number().over(Window.partitionBy("cloud_id").orderBy(away, "pt"))
    return clouds.withColumn("rank", rank).where(F.col("rank") > n).drop("rank")


def dropped(clouds: DataFrame, share: float, seed: int) -> DataFrame:
    """VP9: a random share of points is left out."""
    return clouds.where(maths.uniform(F.lit(seed), F.col("cloud_id"), F.col("pt")) >= share)


def scaled(clouds: DataFrame, low: float, high: float, seed: int) -> DataFrame:
    """VP9: each cloud by its own random factor."""
    f = low + (high - low) * maths.uniform(F.lit(seed), F.col("cloud_id"))
    return clouds.withColumns({c: F.col(c) * f for c in XYZ})


def rescaled_colors(clouds: DataFrame) -> DataFrame:
    """SC12: colours of a cloud are divided by 255 where any is over 1."""
    most = clouds.groupBy("cloud_id").agg(F.max(F.greatest("r", "g", "b")).alias("__most"))
    return clouds.join(most, "cloud_id").withColumns({c: F.when(F.col("__most") > 1, F.col(c) / 255.0).otherwise(F.col(c)) for c in ("r", "g", "b")}).drop("__most")


def allocated(geoms: DataFrame, total: int, group: str = "scene") -> DataFrame:
    """VP10: points of each geom (group, geom, area): a floor, the rest by area, exact in sum; what rounding leaves goes to the first geoms.

    A geom of a scene whose floors are more than the total gives points back from the last on, one each in turn.
    """
    floor = max(300, total // 100)
    g = Window.partitionBy(group)
    rest = F.lit(total) - F.count("*").over(g) * floor
    base = geoms.withColumn("n", (floor + (rest * F.col("area") / F.sum("area").over(g)).cast("long")).cast("long"))
    base = base.withColumns({"__short": F.lit(total) - F.sum("n").over(g), "__size": F.count("*").over(g)})
    up = F.row_number().over(g.orderBy("geom")) - 1
    each, more = F.floor(F.abs("__short") / F.col("__size")), F.pmod(F.abs("__short"), F.col("__size"))
    change = F.signum("__short") * (each + F.when(up < more, 1).otherwise(0))
    return base.withColumn("n", (F.col("n") + change).cast("long")).drop("__short", "__size")


def largest_remainder(faces: DataFrame, group: str, key: str, area: str, total: Column) -> DataFrame:
    """VP11: whole shares of ``total`` by area; the largest remainders get one more."""
    g = Window.partitionBy(group)
    exact = total * F.col(area) / F.sum(area).over(g)
    rows = faces.withColumn("__exact", F.round(exact, 9)).withColumn("n", F.floor("__exact").cast("long"))
    left = total.cast("long") - F.sum("n").over(g)
    rank = F.row_number().over(g.orderBy(F.desc(F.round(F.col("__exact") - F.col("n"), 9)), key))
    return rows.withColumn("__left", left).withColumn("__rank", rank).withColumn("n", F.col("n") + (F.col("__rank") <= F.col("__left")).cast("long")).drop("__exact", "__left", "__rank")


def surface_points(geoms: DataFrame, seed: int) -> DataFrame:
    """VP12: (geom, pt, x, y, z): n points on spheres, ellipsoids, cylinders and capsules of sizes a, b, c, by hash-drawn angles."""
    rows = geoms.withColumn("pt", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    u, v, w = (maths.uniform(F.lit(seed), F.col("geom"), F.col("pt"), F.lit(i)) for i in range(3))
    turn, high = 2 * math.pi * u, 2 * v - 1
    flat = F.sqrt(1 - high * high)
    ball = [flat * F.cos(turn), flat * F.sin(turn), high]
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    side = a * b * 2 / (a * b * 2 + a * a)  # a cylinder's side by its whole surface
    on_side = w < side
    disc = a * F.sqrt(v)
    cylinder = [F.when(on_side, a).otherwise(disc) * F.cos(turn), F.when(on_side, a).otherwise(disc) * F.sin(turn), F.when(on_side, b * high).when(w < (1 + side) / 2, b).otherwise(-b)]
    round_part = a * 2 / (a * 2 + b * 2)
    capsule = [F.when(w < round_part, a * ball[0]).otherwise(a * F.cos(turn)), F.when(w < round_part, a * ball[1]).otherwise(a * F.sin(turn)), F.when(w < round_part, a * ball[2] + F.signum(ball[2]) * b).otherwise(b * high)]
    size = {"sphere": [a, a, a], "ellipsoid": [a, b, c]}
    out = {}
    for i, name in enumerate(XYZ):
        out[name] = (
            F.when(F.col("shape").isin("sphere"), ball[i] * size["sphere"][i]).when(F.col("shape") == "ellipsoid", ball[i] * size["ellipsoid"][i]).when(F.col("shape") == "cylinder", cylinder[i]).when(F.col("shape") == "capsule", capsule[i])
        )
    return rows.withColumns(out).select("geom", "pt", *XYZ)


#: Points drawn in a cell of a mesh's area, about: draws and faces meet cell by cell.
CELL_POINTS = 256


def mesh_points(faces: DataFrame, n: int, seed: int) -> DataFrame:
    """VP12: (mesh, face, pt, x, y, z): n points a mesh (mesh, face, p, q, r as arrays of 3), faces by draws in proportion to area.

    Faces lie end to end in order of their number, as long as their areas; each draw of a hash falls on one. The line is cut into
    cells of about ``CELL_POINTS`` draws; a face is sent to the cells it lies in, so that draws and faces of a mesh meet in
    many small groups. Places on a face are folded barycentric draws. A mesh without area gives its first corners.
    """
    corner = lambda c: [F.col(c)[i] for i in range(3)]
    cells = max(1, n // CELL_POINTS)
    by_mesh = Window.partitionBy("mesh")
    sized = faces.withColumn("area", maths.triangle_area(corner("p"), corner("q"), corner("r")))
    line = sized.withColumns({"high": F.sum("area").over(by_mesh.orderBy("face").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("area").over(by_mesh)})
    last = F.max(F.when(F.col("area") > 0, F.col("face"))).over(by_mesh)  # takes what rounding leaves at the end
    solid = line.withColumns({"low": F.col("high") - F.col("area"), "last": last}).where("area > 0 and total >= 1e-12")
    solid = solid.withColumns({"low": F.col("low") / F.col("total"), "high": F.when(F.col("face") == F.col("last"), 2.0).otherwise(F.col("high") / F.col("total"))})
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("int")
    spread = solid.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high"))))).select("mesh", "cell", "face", "low", "high", "p", "q", "r")
    drawn = solid.select("mesh").distinct().withColumn("pt", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("at", maths.uniform(F.lit(seed), F.col("mesh"), F.col("pt"), F.lit(2)))
    rows = drawn.withColumn("cell", cell(F.col("at"))).join(spread, ["mesh", "cell"]).where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    rank = F.row_number().over(by_mesh.orderBy("face", "corner"))
    flat = line.where("total < 1e-12").select("mesh", "face", F.posexplode(F.array("p", "q", "r")).alias("corner", "v")).withColumn("pt", rank).where(F.col("pt") <= n)
    flat = flat.select("mesh", "face", "pt", *[F.col("v")[i].alias(c) for i, c in enumerate(XYZ)])
    u, v = (maths.uniform(F.lit(seed), F.col("mesh"), F.col("face"), F.col("pt"), F.lit(i)) for i in (0, 1))
    s, t = F.when(u + v > 1, 1 - u).otherwise(u), F.when(u + v > 1, 1 - v).otherwise(v)
    return rows.select("mesh", "face", "pt", *[(F.col("p")[i] + s * (F.col("q")[i] - F.col("p")[i]) + t * (F.col("r")[i] - F.col("p")[i])).alias(c) for i, c in enumerate(XYZ)]).unionByName(flat)


#: Doublings of the pointers between two written tables.
DOUBLINGS = 3


def descendants(spark, bodies: DataFrame, root: int) -> DataFrame:
    """JN17: ids below a body (body, parent), itself included, by pointer doubling: a chain of n bodies takes log2(n) joins.

    Each body points to an ancestor and knows whether the root was passed on the way; a join sends it on to where
    its ancestor points. A body that reached the root, or the top of its tree, rests. Parents are single; bodies that go round in a
    cycle without the root never rest and are given up once the pointers have passed every body.
    """
    first = bodies.select(F.col("body").cast("long").alias("body"), F.col("parent").cast("long").alias("up")).where("body is not null").distinct()
    at = F.lit(int(root)).cast("long")
    state = written(first.where(F.col("body") != at).withColumn("hit", F.coalesce(F.col("up") == at, F.lit(False))), "bodies")
    most, passed = state.count() + 1, 1
    while passed < most and not state.where("not hit and up is not null").isEmpty():
        now = state
        for _ in range(DOUBLINGS):
            onward = now.select(F.col("body").alias("b"), F.col("up").alias("far"), F.col("hit").alias("far_hit"))
            moving = now.where("not hit and up is not null")
            moved = moving.join(onward, F.col("up") == F.col("b"), "left").select("body", F.col("far").alias("up"), F.coalesce("far_hit", F.lit(False)).alias("hit"))
            now = moved.union(now.where("hit or up is null"))
            passed *= 2
        before, state = state, written(now, "bodies")
        release(before)
    return spark.range(1).select(at.alias("body")).union(state.where("hit").select("body").distinct())


def of_bodies(geoms: DataFrame, bodies: DataFrame) -> DataFrame:
    """PF14."""
    return geoms.join(bodies.select("body").distinct(), "body", "left_semi").select("geom").distinct()


def blended(geom: list[Column], material: list[Column], emission: Column, reflectance: Column, specular: Column, shininess: Column) -> list[Column]:
    """MF19: (r, g, b, alpha) of a geom's colour under its material: products, then lightened step by step, each clipped to 0..1.

    Emission is added, reflectance mixes with white, specular is added, half the shininess mixes with white; effects of up to
    1e-9 are none. A geom without a material (its colours null) keeps its own colour.
    """
    own, of = [maths.clipped(c) for c in geom], [maths.clipped(c) for c in material]

    def lightened(base: Column) -> Column:
        on = lambda effect, value, other: F.when(effect > 1e-9, maths.clipped(value)).otherwise(other)
        lit = on(emission, base + emission, base)
        lit = on(reflectance, (1 - reflectance) * lit + reflectance, lit)
        lit = on(specular, lit + specular, lit)
        return on(shininess, lit * (1 - 0.5 * shininess) + 0.5 * shininess, lit)

    mixed = [lightened(a * b) for a, b in zip(own[:3], of[:3], strict=True)] + [own[3] * of[3]]
    return [F.when(material[0].isNull(), a).otherwise(b) for a, b in zip(own, mixed, strict=True)]


def random_order(clouds: DataFrame, seed: int) -> Column:
    return draw(seed, F.col("cloud_id"), F.col("pt"))
