"""Pitch: cents (100 a semitone, A4 = 6900 = 440 Hz), names, chord roots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the twelve semitones, and the letters' semitones from C (fixed values).
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
STEPS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def hz_to_cents(hz: Column) -> Column:
    return F.when(hz > 0, 6900 + 1200 * F.log2(hz / 440))


def cents_to_hz(cents: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (cents - 6900) / 1200)


def semitone(cents: Column) -> Column:
    """The nearest semitone's number, half to even."""
    return F.rint(cents / 100).cast("long")


def note_name(semi: Column) -> Column:
    names = F.array(*(F.lit(n) for n in SHARPS))
    return F.concat(F.get(names, F.pmod(semi, F.lit(12)).cast("int")), (F.floor(semi / 12) - 1).cast("string"))


def _step(letter: Column, sign: Column) -> Column:
    m = F.create_map(*(x for k, v in STEPS.items() for x in (F.lit(k), F.lit(v))))
    return F.try_element_at(m, letter) + F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0)


def name_to_cents(name: Column) -> Column:
    """`F#4`, `Bb3+12c`: cents, or null if it is no note name. The octave is one digit; the c may be missing."""
    shape = "^([A-G])([#b]?)([0-9])([+-][0-9]+)?c?$"
    part = lambda g: F.regexp_extract(name, shape, g)
    octave, cents = part(3).try_cast("int"), F.coalesce(part(4).try_cast("int"), F.lit(0))
    return F.when(name.rlike(shape), ((octave + 1) * 12 + _step(part(1), part(2))) * 100.0 + cents)


def parse_pitch(text: Column) -> Column:
    """Raw cents (`5708c`), a frequency (`~440.0Hz`, whatever the case), or a note name, in this order; else null."""
    raw = F.regexp_extract(text, "^(-?[0-9]+)c$", 1).try_cast("double")
    hz = F.regexp_extract(text, "^~([0-9.]+)[Hh][Zz]$", 1).try_cast("double")
    return F.coalesce(raw, hz_to_cents(hz), name_to_cents(text))


def cents_name(cents: Column) -> Column:
    """The nearest note's name in sharps, with the cents beside it: `A3+8c`; half to even."""
    semi = semitone(cents)
    off = F.rint(cents - semi * 100).cast("long")
    return F.concat(note_name(semi), F.when(off > 0, F.concat(F.lit("+"), off.cast("string"), F.lit("c"))).when(off < 0, F.concat(off.cast("string"), F.lit("c"))).otherwise(""))


#: Roots of chords that have a name of their own (fixed values).
ROOTS = ["C", "C#", "Db", "D", "D#", "Eb", "E", "F", "F#", "Gb", "G", "G#", "Ab", "A", "A#", "Bb", "B"]


def chord_root(symbol: Column, lowest: int = 28) -> Column:
    """Cents of a chord's root in the lowest octave at or above a MIDI number; null for `N`, nothing, or an unusual root (Cb, E#)."""
    name = F.regexp_extract(symbol, "^([A-G][#b]?)", 1)
    root = F.pmod(_step(F.substring(name, 1, 1), F.substring(name, 2, 1)), F.lit(12))
    return F.when(name.isin(ROOTS), (root + 12 * F.ceil((F.lit(lowest) - root) / 12)) * 100.0)
