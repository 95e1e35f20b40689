"""Column expressions on angle arrays [gamma_1..gamma_p, beta_1..beta_p]."""

from __future__ import annotations

import math
from pyspark.sql import Column, functions as F

from restartlab.functions.binding import let

EPS = 2.220446049250313e-16
ANGLE_TIE = 32 * EPS * math.pi
DISTANCE_TIE = 1e-12
GAMMA_PERIOD = 2 * math.pi
BETA_PERIOD = math.pi / 2


def wrap(x: Column, period: Column | float) -> Column:
    """To [-T/2, T/2); points within rounding of the boundary go to -T/2."""
    period = F.lit(period) if isinstance(period, float) else period
    half = period / 2

    def place(w: Column) -> Column:
        w = F.when(w >= half, w - period).when(w < -half, w + period).otherwise(w)
        return F.when(F.abs(F.abs(w) - half) <= 8 * EPS * period, -half).otherwise(w)

    return let(x % period, place)


def _period(i: Column, p: int, beta_period: float) -> Column:
    return F.when(i < p, F.lit(GAMMA_PERIOD)).otherwise(F.lit(beta_period))


def wrap_angles(theta: Column, p: int, beta_period: float = BETA_PERIOD) -> Column:
    return F.transform(theta, lambda x, i: wrap(x, _period(i, p, beta_period)))


def negate(theta: Column) -> Column:
    return F.transform(theta, lambda x: -x)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def separated_first(left: Column, right: Column) -> Column:
    """The smaller lift at the first coordinate of (nearly) largest separation; lexicographic when all gaps are tiny."""
    def choose(s: Column) -> Column:
        gaps = F.zip_with(s["l"], s["r"], lambda x, y: F.abs(x - y))
        return let(F.struct(s["l"].alias("l"), s["r"].alias("r"), gaps.alias("g"), F.array_max(gaps).alias("top")), pick)

    def pick(s: Column) -> Column:
        marks = F.transform(s["g"], lambda g: g >= s["top"] - ANGLE_TIE)
        at = F.array_position(marks, True).cast("int")
        lexical = F.when(s["l"] <= s["r"], s["l"]).otherwise(s["r"])
        spread = F.when(F.element_at(s["l"], at) < F.element_at(s["r"], at), s["l"]).otherwise(s["r"])
        return F.when(s["top"] <= ANGLE_TIE, lexical).otherwise(spread)

    return let(F.struct(left.alias("l"), right.alias("r")), choose)


def canonical(theta: Column, p: int) -> Column:
    return separated_first(wrap_angles(theta, p), wrap_angles(negate(theta), p))


def quotient_distance(a: Column, b: Column, p: int) -> Column:
    """Distance on the torus modulo the common sign."""
    return F.least(norm(wrap_angles(minus(a, b), p)), norm(wrap_angles(plus(a, b), p)))


def align_to_anchor(theta: Column, anchor: Column, p: int) -> Column:
    """Nearest periodic and sign lift of a point to a fixed anchor."""
    def lifts(s: Column) -> Column:
        l = plus(s["a"], wrap_angles(minus(s["c"], s["a"]), p))
        r = plus(s["a"], wrap_angles(minus(negate(s["c"]), s["a"]), p))
        return let(F.struct(l.alias("l"), r.alias("r"), norm(minus(l, s["a"])).alias("dl"), norm(minus(r, s["a"])).alias("dr")), choose)

    def choose(s: Column) -> Column:
        return (F.when(F.abs(s["dl"] - s["dr"]) <= DISTANCE_TIE, separated_first(s["l"], s["r"]))
                .when(s["dl"] < s["dr"], s["l"]).otherwise(s["r"]))

    return let(F.struct(canonical(theta, p).alias("c"), anchor.alias("a")), lifts)


def orbit(theta: Column, parity: Column, p: int) -> Column:
    """Array of (mask, sign, theta): gamma shifts by pi, odd degrees flip betas from that layer, both signs."""
    masks = F.sequence(F.lit(0), F.when(parity == "mixed", F.lit(0)).otherwise(F.lit(2 ** p - 1)))

    def moved(mask: Column, sign: int) -> Column:
        def coordinate(x: Column, i: Column) -> Column:
            layer = F.when(i < p, i).otherwise(i - p).cast("int")
            bit = F.call_function("shiftright", mask, layer).bitwiseAND(F.lit(1))
            below = mask.bitwiseAND(F.call_function("shiftleft", F.lit(2), layer) - 1)
            flip = F.when((parity == "odd") & (F.bit_count(below) % 2 == 1), F.lit(-1.0)).otherwise(F.lit(1.0))
            return sign * F.when(i < p, x + bit * math.pi).otherwise(x * flip)

        return F.struct(mask.cast("bigint").alias("mask"), F.lit(sign).cast("bigint").alias("sign"), F.transform(theta, coordinate).alias("theta"))

    return F.flatten(F.transform(masks, lambda m: F.array(moved(m, 1), moved(m, -1))))


def align_label(theta: Column, anchor: Column, parity: Column, p: int) -> Column:
    """Nearest orbit lift (mask, sign, lift, distance, tie) with the coordinate-wise tie rule."""
    def candidate(o: Column) -> Column:
        lift = plus(anchor, wrap_angles(minus(o["theta"], anchor), p))
        return let(F.struct(lift.alias("lift"), o["mask"].alias("mask"), o["sign"].alias("sign")), lambda s: F.struct(
            s["lift"].alias("lift"), s["mask"].alias("mask"), s["sign"].alias("sign"), norm(minus(s["lift"], anchor)).alias("distance")))

    def narrow(active: Column, _: Column) -> Column:
        dims = F.sequence(F.lit(1), F.lit(2 * p))
        values = lambda d: F.transform(active, lambda c: F.element_at(c["lift"], d))
        spread = F.transform(dims, lambda d: F.array_max(values(d)) - F.array_min(values(d)))

        def keep(s: Column) -> Column:
            ok = F.transform(s["spread"], lambda g: (g > ANGLE_TIE) & (g >= F.array_max(s["spread"]) - ANGLE_TIE))
            at = F.array_position(ok, True).cast("int")
            return let(at, lambda i: F.filter(active, lambda c: F.element_at(c["lift"], i) <= F.array_min(values(i)) + ANGLE_TIE))

        return F.when(F.size(active) <= 1, active).otherwise(let(F.struct(spread.alias("spread")), lambda s: F.when(
            F.array_max(s["spread"]) <= ANGLE_TIE, active).otherwise(keep(s))))

    def nearest(all_lifts: Column) -> Column:
        least = F.array_min(F.transform(all_lifts, lambda c: c["distance"]))
        return F.filter(all_lifts, lambda c: c["distance"] <= least + DISTANCE_TIE)

    def settle(active: Column) -> Column:
        final = F.aggregate(F.sequence(F.lit(1), F.lit(2 * p)), active, narrow)
        return let(F.array_min(final), lambda w: F.struct(w["mask"].alias("mask"), w["sign"].alias("sign"), w["lift"].alias("lift"),
                                                         w["distance"].alias("distance"), (F.size(active) > 1).alias("tie")))

    return let(let(F.transform(orbit(theta, parity, p), candidate), nearest), settle)


def encode(theta: Column, p: int) -> Column:
    """(sin, cos) of gammas and (sin, cos) of four times the betas, coordinate by coordinate."""
    def pair(x: Column, i: Column) -> Column:
        return let(x * F.when(i < p, F.lit(1.0)).otherwise(F.lit(4.0)), lambda y: F.array(F.sin(y), F.cos(y)))

    return F.flatten(F.transform(theta, pair))


def decode(prediction: Column, anchor: Column, p: int, small: float = 1e-8) -> Column:
    """(theta, rho, fallback): any tiny circle sends the whole point to the anchor."""
    dims = F.sequence(F.lit(0), F.lit(2 * p - 1))
    at = lambda k: F.element_at(prediction, k.cast("int"))
    rho = F.transform(dims, lambda i: F.hypot(at(2 * i + 1), at(2 * i + 2)))
    angles = F.transform(dims, lambda i: F.atan2(at(2 * i + 1), at(2 * i + 2)) / F.when(i < p, F.lit(1.0)).otherwise(F.lit(4.0)))

    def finish(s: Column) -> Column:
        bad = F.exists(s["rho"], lambda r: r < small)
        return F.struct(canonical(F.when(bad, anchor).otherwise(s["angles"]), p).alias("theta"), s["rho"].alias("rho"), bad.alias("fallback"))

    return let(F.struct(rho.alias("rho"), angles.alias("angles")), finish)


def angle_loss(prediction: Column, target: Column, parity: Column, p: int) -> Column:
    """Smallest mean squared wrapped residual over the target's orbit."""
    def residual(o: Column) -> Column:
        return F.aggregate(wrap_angles(minus(prediction, o["theta"]), p), F.lit(0.0), lambda a, x: a + x * x) / (2 * p)

    return F.array_min(F.transform(orbit(target, parity, p), residual))
