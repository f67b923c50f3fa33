"""Ion names: grammar, formatting and reduction.

A name is a list of atoms separated by blanks, each with an optional leading isotope and
trailing count, then '+' or '-' signs for the charge: ``56Fe2 16O3 ++``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from iontide.schema import ATOM

#: Element symbols in order of atomic number, from hydrogen.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"
).split()
ATOMIC_NUMBER = {e: i + 1 for i, e in enumerate(ELEMENTS)}

_ATOM = re.compile(r"(\d*)([A-Z][a-z]?)(\d*)")


def parse(name: str) -> tuple[list[tuple[str, int | None]], int]:
    """Atoms (element, isotope or None) and the charge; raises ValueError for other text."""
    body = name.strip()
    charge = body.count("+") - body.count("-")
    body = body.replace("+", "").replace("-", "").strip()
    atoms: list[tuple[str, int | None]] = []
    for token in body.split():
        at = 0
        for m in _ATOM.finditer(token):
            if m.start() != at or m[2] not in ATOMIC_NUMBER:
                break
            atoms += [(m[2], int(m[1]) if m[1] else None)] * int(m[3] or 1)
            at = m.end()
        if at != len(token):
            raise ValueError(f"not an ion name: {name!r}")
    return canonical(atoms), charge


def canonical(atoms: Iterable[tuple[str, int | None]]) -> list[tuple[str, int | None]]:
    """Heavier elements first, then heavier isotopes, unspecified last."""
    return sorted(atoms, key=lambda a: (-ATOMIC_NUMBER.get(a[0], 0), a[0], -(a[1] or 0)))


def compose(atoms: Iterable[tuple[str, int | None]], charge: int = 0, latex: bool = False) -> str:
    runs: list[list] = []
    for a in canonical(atoms):
        if runs and runs[-1][0] == a:
            runs[-1][1] += 1
        else:
            runs.append([a, 1])
    if latex:
        words = [f"{'^{%d}' % i if i else ''}{e}{'_{%d}' % n if n > 1 else ''}" for (e, i), n in runs]
    else:
        words = [f"{i or ''}{e}{n if n > 1 else ''}" for (e, i), n in runs]
    sign = "+" * charge if charge >= 0 else "-" * -charge
    return (" ".join(words) + (" " + sign if sign and not latex else "^{%s}" % sign if sign else "")).strip()


def charge_of(name: Column) -> Column:
    """Number of '+' less that of '-'."""
    return F.length(F.regexp_replace(name, "[^+]", "")) - F.length(F.regexp_replace(name, "[^-]", ""))


def reduce_name(name: Column, mode: str) -> Column:
    """'ionic' drops the charge, 'isotopic' keeps all but the charge's blanks, 'atomic' drops charge and isotopes."""
    plain = F.trim(F.regexp_replace(name, "[+-]", ""))
    if mode == "ionic":
        return F.regexp_replace(plain, r"(^|\s)\d+(?=[A-Z])", "$1")
    if mode == "isotopic":
        return plain
    if mode == "atomic":
        return F.regexp_replace(F.regexp_replace(plain, r"(^|\s)\d+(?=[A-Z])", "$1"), r"(?<=[A-Za-z])\d+", "")
    raise ValueError(f"mode {mode!r}: ionic, isotopic or atomic")


def atoms_of(name: Column) -> Column:
    """ARRAY<STRUCT<element, isotope>> of an ion name, one entry per atom, in the order of the text."""
    words = F.regexp_extract_all(F.regexp_replace(name, "[+-]", ""), F.lit(r"(\d*[A-Z][a-z]?\d*)"), F.lit(1))

    def expanded(word: Column) -> Column:
        isotope = F.regexp_extract(word, r"^(\d*)", 1)
        count = F.regexp_extract(word, r"(\d*)$", 1)
        atom = F.struct(F.regexp_extract(word, "([A-Z][a-z]?)", 1).alias("element"), F.when(isotope != "", isotope.cast("int")).alias("isotope")).cast(ATOM)
        return F.array_repeat(atom, F.when(count != "", count.cast("int")).otherwise(1))

    return F.flatten(F.transform(words, expanded))


def elements_in(text: str) -> list[str]:
    """Element symbols that stand alone in a text, in order of appearance."""
    found = [w for w in re.findall(r"(?<![A-Za-z])([A-Z][a-z]?)(?![A-Za-z])", text) if w in ATOMIC_NUMBER]
    return list(dict.fromkeys(found))


def sort_key(name: Column, by: str = "number") -> Column:
    """For ordering categories: names, or the first element's atomic number; others are null and sort last."""
    if by == "name":
        return name
    table = F.create_map(*(F.lit(v) for pair in ATOMIC_NUMBER.items() for v in pair))
    return table[F.regexp_extract(name, "([A-Z][a-z]?)", 1)]
