"""Scalars of the note domain: drum voices, families, parts, note lines, velocities, phones, file names, production lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pitch import cents_name

#: Voices of General MIDI drum notes (fixed values); note 35 reads as a kick too, a voice without a note is a clap.
DRUMS = {
    "kick.acoustic": 35, "kick": 36, "stick": 37, "snare": 38, "clap": 39, "snare.electric": 40, "tom.floor.lo": 41, "hat": 42, "tom.lo": 43, "hat.pedal": 44, "tom.lo.mid": 45, "hat.open": 46,
    "tom.mid": 47, "tom.hi.mid": 48, "crash": 49, "tom.hi": 50, "ride": 51, "china": 52, "ride.bell": 53, "tamb": 54, "splash": 55, "cowbell": 56, "crash.2": 57, "ride.2": 59, "shaker": 70,
}
CLAP = 39
#: Parts by the family of an instrument (fixed values); others are "other".
PARTS = ["lead_vocals", "backing_vocals", "piano", "guitar", "bass", "drums", "other", "residual"]
FAMILY_PART = {"voice": "lead_vocals", "drums": "drums", "bass": "bass", "keys": "piano", "gtr": "guitar"}
#: Families of streams without an instrument (fixed values).
STREAM_FAMILY = {"bass": "bass", "vox": "voice", "bvox": "voice", "guitar": "gtr", "piano": "keys"}
#: Vowels, and what a letter is guessed to sound like where the dictionary lacks a word (fixed values).
VOWELS = ["aa", "ae", "ah", "ao", "aw", "ax", "ay", "eh", "er", "ey", "ih", "iy", "ow", "oy", "uh", "uw"]
LETTERS = {
    "a": "ae", "b": "b", "c": "k", "d": "d", "e": "eh", "f": "f", "g": "g", "h": "hh", "i": "ih", "j": "jh", "k": "k", "l": "l", "m": "m",
    "n": "n", "o": "aa", "p": "p", "q": "k", "r": "r", "s": "s", "t": "t", "u": "ah", "v": "v", "w": "w", "x": "k s", "y": "iy", "z": "z",
}
#: Ranges of the numbers of a production line (fixed values); 31 equaliser bands lie within 60 dB.
FX_RANGES = {"rt60": (0.1, 4.0), "wet": (0.0, 1.0), "width": (0.0, 1.0), "pan": (-1.0, 1.0), "crest": (0.0, 60.0)}
FX_BANDS, FX_MOST = 31, 60


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _three(c: Column) -> Column:
    """Three digits, rounded before they are written."""
    return F.format_string("%.3f", F.floor(c * 1000 + 0.5) / 1000)


def drum_voice(note: Column) -> Column:
    """A drum note's voice, `gmNN` for notes without a name."""
    return F.coalesce(F.try_element_at(_map({n: v for v, n in DRUMS.items()} | {35: "kick"}), note.cast("int")), F.concat(F.lit("gm"), note.cast("string")))


def drum_note(voice: Column) -> Column:
    own = F.regexp_extract(voice, "^gm([0-9]+)$", 1).try_cast("int")
    return F.coalesce(own, F.try_element_at(_map(DRUMS), voice), F.lit(CLAP))


def drum_family(note: Column) -> Column:
    """kick, snare, hat, clap or other."""
    stem = F.substring_index(drum_voice(note), ".", 1)
    return F.when(stem.isin("kick", "snare", "hat", "clap"), stem).otherwise("other")


def bend_cents(bins: Column) -> Column:
    """Cents of pitch bend bins (thirds of a semitone, 1 in tune); without bins 0."""
    mean = F.aggregate(bins, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.nullif(F.size(bins), F.lit(0))
    return F.coalesce((mean - 1) * 100 / 3, F.lit(0.0))


def family(stream: Column, inst: Column) -> Column:
    """The family of a stream: percussion by its name or instrument, else the instrument's, else by the stream's last name."""
    drums = stream.startswith("perc.") | inst.startswith("drums") | inst.startswith("perc")
    own = F.when(F.coalesce(inst, F.lit("unknown")).isin("", "unknown"), F.try_element_at(_map(STREAM_FAMILY), F.substring_index(stream, ".", -1))).otherwise(F.substring_index(inst, ".", 1))
    return F.when(drums, "drums").otherwise(F.coalesce(own, F.lit("unknown")))


def part_key(stream: Column, inst: Column, stem: Column) -> Column:
    """The part of a stream: its stem where that is a part, percussion is drums, else by the family."""
    return F.when(stem.isin(PARTS), stem).when(stream.startswith("perc."), "drums").otherwise(F.coalesce(F.try_element_at(_map(FAMILY_PART), family(stream, inst)), F.lit("other")))


def bar_beat(seconds: Column, downbeat: Column, bar: Column, beats: int = 4) -> Column:
    """`3:2.500` by a grid of equal bars, `@1.250` before the downbeat; a millionth of a second counts as on it."""
    t = F.greatest(seconds - downbeat, F.lit(0.0))
    n = F.floor((t + 1e-9) / bar)
    beat = (t - n * bar) / (bar / beats) + 1
    return F.when(seconds < downbeat - 1e-6, F.concat(F.lit("@"), _three(seconds))).otherwise(F.concat((n + 1).cast("string"), F.lit(":"), _three(beat)))


def note_line(at: Column, voice: Column, cents: Column, beats: Column, vel: Column) -> Column:
    """`at voice vel` for a drum, `at  name  0.750b vel` for a pitch; lengths are 0.01 at least."""
    pitched = F.concat(at, F.lit("  "), cents_name(cents), F.lit("  "), _three(F.greatest(beats, F.lit(0.01))), F.lit("b "), vel.cast("string"))
    return F.when(voice.isNotNull(), F.concat_ws(" ", at, voice, vel.cast("string"))).otherwise(pitched)


def velocity(share: Column, power: float = 0.5) -> Column:
    """1 to 127 from an amplitude's share of the peak; notes have the power 0.5, drums 0.4."""
    return F.rint(F.greatest(F.lit(1.0), F.least(F.lit(127.0), 20 + 107 * F.pow(share, F.lit(power))))).cast("long")


def quantised(beats: Column, per_beat: int) -> Column:
    """The nearest grid place, per_beat places a beat (2 for notes, 4 for drums), half to even."""
    return F.rint(beats * per_beat) / per_beat


def phones(word: Column, entry: Column) -> tuple[Column, Column]:
    """(phones, whether the dictionary has the word) of a word and its dictionary entry: an unstressed `ah0` is `ax`, digits
    go; without an entry the letters are guessed, at least `ah`."""
    told = F.transform(F.split(F.lower(entry), " "), lambda p: F.when(p == "ah0", "ax").otherwise(F.regexp_replace(p, "[0-9]", "")))
    letter = F.filter(F.transform(F.split(word, ""), lambda c: F.try_element_at(_map(LETTERS), c)), lambda x: x.isNotNull())
    guess = F.split(F.coalesce(F.nullif(F.array_join(letter, " "), F.lit("")), F.lit("ah")), " ")
    return F.when(entry.isNotNull(), told).otherwise(guess), entry.isNotNull()


def dictionary_keys(word: Column) -> Column:
    """The forms under which a word is looked up, in order: itself, without apostrophes, and `in'` as `ing`."""
    return F.filter(F.array(word, F.regexp_replace(word, "'", ""), F.when(word.endswith("in"), F.concat(word, F.lit("g")))), lambda x: x.isNotNull())


def syllables(p: Column, vowels: list[str] = VOWELS) -> Column:
    """ARRAY of syllables (arrays of phones): each has one vowel; of the consonants between two vowels the last begins the
    next syllable. Phones without a vowel are one syllable."""
    at = F.filter(F.transform(p, lambda x, i: F.when(x.isin(vowels), i)), lambda i: i.isNotNull())
    after = F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0)))
    cuts = F.transform(after, lambda v: F.when(F.get(p, v - 1).isin(vowels), v).otherwise(v - 1))
    starts, ends = F.concat(F.array(F.lit(0)), cuts), F.concat(cuts, F.array(F.size(p)))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.slice(p, z["a"] + 1, z["b"] - z["a"]))


def model_label(path: Column) -> Column:
    """What a model's output file holds: the last `_(Label)` of its name, in lower case; null without one."""
    found = F.regexp_extract_all(F.substring_index(path, "/", -1), F.lit("_\\(([^)]+)\\)"), F.lit(1))
    return F.lower(F.trim(F.try_element_at(found, F.lit(-1))))


def kit_voice(path: Column) -> Column:
    """The voice of a kit's file: its name before the ending and the last `_`."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), "\\.[^.]*$", ""), "_[^_]*$", "")


def title_artist(stem: Column) -> Column:
    """STRUCT(title, artist) of a file's name: `A - T`, `Title-CamelCase`, else the name alone with a null artist."""
    dash, camel = "^(.*?) - (.*)$", "^(.+)-([A-Z][a-z]+(?:[A-Z][a-z]+)+)$"
    title = F.when(stem.rlike(dash), F.regexp_extract(stem, dash, 2)).when(stem.rlike(camel), F.regexp_extract(stem, camel, 1)).otherwise(stem)
    artist = F.when(stem.rlike(dash), F.regexp_extract(stem, dash, 1)).when(stem.rlike(camel), F.regexp_replace(F.regexp_extract(stem, camel, 2), "([a-z])([A-Z])", "$1 $2"))
    return F.struct(F.when(stem.rlike(f"{dash}|{camel}"), F.trim(title)).otherwise(title).alias("title"), F.trim(artist).alias("artist"))


def fx_values(args: Column) -> Column:
    """STRUCT(eq, rt60, wet, width, pan, crest) of a production line's arguments. Numbers are cut to their ranges, what is no
    number is null; eq is empty unless it has exactly 31 whole numbers. Of equal keys the last that can be read holds."""
    last = lambda key, read: F.try_element_at(F.filter(F.transform(F.filter(args, lambda a: F.substring_index(a, "=", 1) == key), lambda a: read(F.regexp_replace(a, "^[^=]*=?", ""))), lambda x: x.isNotNull()), F.lit(-1))

    def bands(v: Column) -> Column:
        cells = F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")
        values = F.transform(cells, lambda x: F.greatest(F.lit(-FX_MOST), F.least(F.lit(FX_MOST), x.try_cast("int"))))
        return F.when(F.exists(cells, lambda x: x.try_cast("int").isNull()), F.lit(None)).when(F.size(values) == FX_BANDS, values).otherwise(F.array().cast("array<int>"))

    def number(low: float, high: float):
        plain = lambda v: F.regexp_replace(v, "[sdB]+$", "").try_cast("double")
        return lambda v: F.when(~F.isnan(plain(v)) & (F.abs(plain(v)) != float("inf")), F.greatest(F.lit(low), F.least(F.lit(high), plain(v))))

    return F.struct(F.coalesce(last("eq", bands), F.array().cast("array<int>")).alias("eq"), *(last(k, number(*r)).alias(k) for k, r in FX_RANGES.items()))


def fx_line(eq: Column, rt60: Column, wet: Column, width: Column, pan: Column, crest: Column) -> Column:
    """The production line that fx_values reads."""
    two = lambda c: F.format_string("%.2f", c)
    return F.concat(F.lit("fx      eq="), F.array_join(eq.cast("array<string>"), ","), F.lit("  rt60="), two(rt60), F.lit("s  wet="), two(wet), F.lit("  width="), two(width), F.lit("  pan="), two(pan), F.lit("  crest="), F.format_string("%.1f", crest), F.lit("dB"))


def dictionary_phones(words: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """words with `phones` and `known`: the entry (key, entry) of the first form that the dictionary has, else a guess. The
    forms meet the dictionary in a join, a row a form."""
    forms = words.select(word).distinct().select(word, F.posexplode(dictionary_keys(F.col(word))).alias("_n", "key"))
    found = forms.join(dictionary, "key").groupBy(word).agg(F.min_by("entry", "_n").alias("_entry"))
    told, known = phones(F.col(word), F.col("_entry"))
    return words.join(found, word, "left").withColumn("phones", told).withColumn("known", known).drop("_entry")
