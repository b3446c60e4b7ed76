"""Symmetric 3 x 3 matrices in columns: eigenvalues and eigenvectors in closed form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once, however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _named(**columns: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in columns.items()])


def eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """The eigenvalues, greatest first, as an array. The trigonometric solution of the characteristic cubic is exact to
    rounding only for the root that lies apart from the others; that one's eigenvector is split off, and the other two
    follow from the 2 x 2 matrix across it, so that equal and vanishing ones come out right as well."""

    def scale(m: Column) -> Column:
        return let(_named(q=(m["xx"] + m["yy"] + m["zz"]) / 3), lambda s: let(_named(
            q=s["q"],
            p=F.sqrt(F.greatest(((m["xx"] - s["q"]) * (m["xx"] - s["q"]) + (m["yy"] - s["q"]) * (m["yy"] - s["q"]) + (m["zz"] - s["q"]) * (m["zz"] - s["q"]) + 2 * (m["xy"] * m["xy"] + m["xz"] * m["xz"] + m["yz"] * m["yz"])) / 6, F.lit(0.0))),
        ), lambda t: F.when(t["p"] <= 1e-12 * F.greatest(F.abs(t["q"]), F.lit(1e-30)), F.array(t["q"], t["q"], t["q"])).otherwise(split(m, apart(m, t)))))

    def apart(m: Column, t: Column) -> Column:
        """The root farthest from the others: the greatest if the halved determinant of the scaled matrix is positive."""
        unit = _named(**{n: (m[n] - t["q"]) / t["p"] for n in ("xx", "yy", "zz")}, **{n: m[n] / t["p"] for n in ("xy", "xz", "yz")})
        half = lambda b: (b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])) / 2
        angle = lambda d: F.acos(F.greatest(F.least(d, F.lit(1.0)), F.lit(-1.0))) / 3
        return let(let(unit, half), lambda d: t["q"] + 2 * t["p"] * F.cos(angle(d) + F.when(d >= 0, F.lit(0.0)).otherwise(F.lit(2 * 3.141592653589793 / 3))))

    def split(m: Column, root: Column) -> Column:
        form = lambda a, b: sum(m["".join(sorted(i + j))] * a[k] * b[n] for k, i in enumerate("xyz") for n, j in enumerate("xyz"))
        axis = eigenvector(root, *(m[n] for n in ("xx", "xy", "xz", "yy", "yz", "zz")))

        def across(v: Column) -> Column:
            wide = F.abs(v[0]) > F.abs(v[1])
            flat = F.sqrt(F.when(wide, v[0] * v[0]).otherwise(v[1] * v[1]) + v[2] * v[2])
            return F.when(wide, F.array(-v[2] / flat, F.lit(0.0), v[0] / flat)).otherwise(F.array(F.lit(0.0), v[2] / flat, -v[1] / flat))

        def both(v: Column, u: Column) -> Column:
            w = F.array(v[1] * u[2] - v[2] * u[1], v[2] * u[0] - v[0] * u[2], v[0] * u[1] - v[1] * u[0])
            return let(w, lambda w: let(_named(one=form(v, v), a=form(u, u), b=form(u, w), d=form(w, w)), lambda r: let(F.sqrt((r["a"] - r["d"]) * (r["a"] - r["d"]) / 4 + r["b"] * r["b"]), lambda h: F.sort_array(F.array(r["one"], (r["a"] + r["d"]) / 2 + h, (r["a"] + r["d"]) / 2 - h), asc=False))))

        return let(axis, lambda v: let(across(v), lambda u: both(v, u)))

    return let(_named(xx=xx, xy=xy, xz=xz, yy=yy, yz=yz, zz=zz), scale)


def eigenvector(value: Column, xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """A unit eigenvector of an eigenvalue, as an array: the longest cross product of two rows of A - value I; the z axis
    where all vanish."""

    def longest(m: Column) -> Column:
        rows = [(m["a"], m["xy"], m["xz"]), (m["xy"], m["b"], m["yz"]), (m["xz"], m["yz"], m["c"])]
        cross = []
        for i, j in ((0, 1), (0, 2), (1, 2)):
            (a, b, c), (d, e, f) = rows[i], rows[j]
            cross.append(let(_named(x=b * f - c * e, y=c * d - a * f, z=a * e - b * d), lambda v: _named(n=v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"], x=v["x"], y=v["y"], z=v["z"])))
        axis = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))
        return let(F.array_max(F.array(*cross)), lambda v: F.when(v["n"] > 0, F.array(*[v[k] / F.sqrt(v["n"]) for k in "xyz"])).otherwise(axis))

    return let(value, lambda w: let(_named(a=xx - w, b=yy - w, c=zz - w, xy=xy, xz=xz, yz=yz), longest))
