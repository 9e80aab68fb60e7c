"""Locales: folding, stop words, geo intent, stems and the Polish locative, as data and Column builders."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, normalize, strip_diacritics, trimmed

#: Word edges and white space of the patterns, spelled out so that they mean the same in every engine.
_B0, _B1 = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_S = r"[\s\x{00A0}\x{FEFF}\x{2028}\x{2029}]"


def _letters(pattern: str) -> str:
    """The longest run of letters that whatever fits a pattern must hold; nothing for patterns of more than letters, edges and white space."""
    plain = pattern.replace(_B0, " ").replace(_B1, " ").replace(_S, " ").replace("[A-Za-z0-9_]", " ")
    return max(re.findall("[a-z]+", plain), key=len, default="") if re.fullmatch("(?:[a-z]+| [+*]?)*", plain) else ""


def _replaced(text: Column, letters: str, pattern: str, by: str) -> Column:
    """text with what fits the pattern replaced, if it holds the letters; else text itself, unread by the pattern."""
    return bound(text, lambda x: F.when(F.contains(x, F.lit(letters)), F.regexp_replace(x, pattern, by)).otherwise(x))


def _spaced(text: Column) -> Column:
    """Runs of white space collapsed, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@dataclass(frozen=True)
class Locale:
    name: str = "generic"
    folds: dict[str, str] = field(default_factory=dict)
    stop_tokens: tuple[str, ...] = ()
    stop_phrases: tuple[str, ...] = ()
    geo_patterns: tuple[str, ...] = ()
    stems: Callable[[Column], Column] | None = None

    def fold(self, text: Column) -> Column:
        return strip_diacritics(text, self.folds)

    def normalize(self, text: Column) -> Column:
        return normalize(text, self.folds)

    def has_geo_intent(self, query: Column) -> Column:
        """Whether a pattern occurs in the folded, lower-cased query; never without patterns."""
        return bound(F.lower(self.fold(F.coalesce(query, F.lit("")))), self._found) if self.geo_patterns else F.lit(False)

    def geo(self, query: Column) -> Column:
        """has_geo_intent and strip_geo_intent as a structure of `intent` and `rest`; the query is folded once."""
        if not self.geo_patterns:
            return F.struct(F.lit(False).alias("intent"), query.alias("rest"))
        both = lambda text: F.struct(self._found(text).alias("intent"), _spaced(self._without_intent(text, "")).alias("rest"))
        return bound(F.lower(self.fold(F.coalesce(query, F.lit("")))), both)

    def _found(self, text: Column) -> Column:
        return reduce(or_, [F.contains(text, F.lit(_letters(p))) & text.rlike(f"(?i){p}") for p in self.geo_patterns])

    def strip_geo_intent(self, query: Column) -> Column:
        """The query with the first occurrence of each pattern, in order, removed; spaces collapsed. Unchanged without patterns."""
        if not self.geo_patterns:
            return query
        return _spaced(self._without_intent(F.lower(self.fold(F.coalesce(query, F.lit("")))), ""))

    def _without_intent(self, text: Column, by: str) -> Column:
        """Lower-case text with the first occurrence of each pattern, in order, replaced.

        A pattern is looked for only in texts that hold its longest run of letters; others stay as they are.
        """
        out = text
        for p in self.geo_patterns:
            out = _replaced(out, _letters(p), f"(?is)\\A(.*?){p}", f"$1{by}")
        return out

    def _without_phrases(self, normalized: Column) -> Column:
        out = self._without_intent(normalized, " ")
        for phrase in sorted(self.stop_phrases, key=len, reverse=True):
            out = _replaced(out, phrase, f"{_B0}{phrase}{_B1}", " ")
        return out

    def strip_stop_words(self, normalized: Column) -> Column:
        """Normalised text without geo intent, stop phrases (longest first) and stop tokens. Unchanged in a locale without any."""
        if not (self.geo_patterns or self.stop_phrases or self.stop_tokens):
            return normalized
        out = self._without_phrases(normalized)
        tokens = F.filter(F.split(F.regexp_replace(out, r"\s+", " "), " "), lambda t: (t != "") & ~t.isin(list(self.stop_tokens)) if self.stop_tokens else t != "")
        return F.array_join(tokens, " ")


GENERIC = Locale()

#: Letters that canonical decomposition doesn't fold, and the rest of the alphabet's.
POLISH_FOLDS = {"ą": "a", "Ą": "A", "ć": "c", "Ć": "C", "ę": "e", "Ę": "E", "ł": "l", "Ł": "L", "ń": "n", "Ń": "N", "ó": "o", "Ó": "O", "ś": "s", "Ś": "S", "ź": "z", "Ź": "Z", "ż": "z", "Ż": "Z"}
#: Stop phrases and stop tokens.
POLISH_STOP_PHRASES = ("szkola jogi", "szkoly jogi", "studio jogi", "studia jogi", "zajecia jogi", "lekcje jogi", "klasy jogi", "yoga studio", "yoga school", "yoga class")
POLISH_STOP_TOKENS = tuple(
    "joga yoga w z na do od dla i o u ze przy po pod nad za przed miedzy lub sie jak co to jest sa nie tak czy tu tam ten ta te "
    "okolicy okolice okolica okolicach okolicami poblizu rejon rejonie rejonu sasiedztwie centrum okolo praca kurs kursy lekcje zajecia treningi".split()
)
#: Patterns of "near me" in order.
POLISH_GEO = (
    rf"{_B0}blisko{_S}+mnie{_B1}",
    rf"{_B0}blisko{_B1}",
    rf"{_B0}niedaleko{_B1}",
    rf"{_B0}w{_S}+poblizu{_B1}",
    rf"{_B0}obok{_B1}",
    rf"{_B0}w{_S}+okolic[A-Za-z0-9_]*{_B1}",
    rf"{_B0}najblizej{_B1}",
    rf"{_B0}najblizsz[A-Za-z0-9_]*",
    rf"{_B0}kolo{_S}+mnie{_B1}",
    rf"{_B0}w{_S}+sasiedztwie{_B1}",
    rf"{_B0}w{_S}+moim{_S}+rejonie{_B1}",
    rf"{_B0}near{_S}*me{_B1}",
    rf"{_B0}nearby{_B1}",
    rf"{_B0}closest{_B1}",
    rf"{_B0}around{_S}+me{_B1}",
)
#: Endings and what they become, each tried on its own.
STEM_ENDINGS = (("owie", "ow"), ("odzi", "odz"), ("owej", "owa"), ("ach", ""), ("ami", ""), ("nie", "n"), ("cie", "c"), ("zie", "z"), ("skie", "sk"), ("y", ""), ("i", ""), ("e", ""), ("u", ""))


def _stem_word(word: Column) -> Column:
    """The word, then what each ending that it has gives, if of 3 characters or more."""
    def stem(ending: str, becomes: str) -> Column:
        cut = F.concat(F.substr(word, F.lit(1), F.length(word) - len(ending)), F.lit(becomes))
        return F.when(word.endswith(ending) & (F.length(cut) >= 3) & (cut != word), cut)

    return F.filter(F.array(word, *[stem(a, b) for a, b in STEM_ENDINGS]), lambda x: x.isNotNull())


def polish_stems(token: Column) -> Column:
    """Stems of one word, repeats and all; of several words all combinations, distinct, the token itself first."""
    words = F.split(token, r"\s+")
    joined = F.aggregate(
        F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
        _stem_word(F.get(words, F.lit(0))),
        lambda heads, w: F.flatten(F.transform(heads, lambda h: F.transform(_stem_word(w), lambda s: F.concat(h, F.lit(" "), s)))),
    )
    return F.when(F.size(words) == 1, _stem_word(token)).otherwise(F.array_distinct(F.concat(F.array(token), joined)))


POLISH = Locale("pl", POLISH_FOLDS, POLISH_STOP_TOKENS, POLISH_STOP_PHRASES, POLISH_GEO, polish_stems)

#: Irregular locatives, names and then words of names.
LOCATIVES = {
    "Kraków": "Krakowie", "Wrocław": "Wrocławiu", "Łódź": "Łodzi", "Poznań": "Poznaniu", "Gdańsk": "Gdańsku", "Gdynia": "Gdyni",
    "Szczecin": "Szczecinie", "Bydgoszcz": "Bydgoszczy", "Lublin": "Lublinie", "Białystok": "Białymstoku", "Katowice": "Katowicach",
    "Częstochowa": "Częstochowie", "Radom": "Radomiu", "Sosnowiec": "Sosnowcu", "Toruń": "Toruniu", "Kielce": "Kielcach", "Rzeszów": "Rzeszowie",
    "Gliwice": "Gliwicach", "Olsztyn": "Olsztynie", "Zabrze": "Zabrzu", "Opole": "Opolu", "Tychy": "Tychach", "Płock": "Płocku", "Elbląg": "Elblągu",
    "Tarnów": "Tarnowie", "Chorzów": "Chorzowie", "Bytom": "Bytomiu", "Piła": "Pile", "Legnica": "Legnicy", "Jaworzno": "Jaworznie",
    "Siedlce": "Siedlcach", "Mysłowice": "Mysłowicach", "Konin": "Koninie", "Inowrocław": "Inowrocławiu", "Skierniewice": "Skierniewicach",
    "Sopot": "Sopocie", "Warszawa": "Warszawie", "Bełchatów": "Bełchatowie", "Bielany Wrocławskie": "Bielanach Wrocławskich", "Borkowo": "Borkowie",
    "Brzozówka": "Brzozówce", "Czeladź": "Czeladzi", "Górki": "Górkach", "Kamionki": "Kamionkach", "Komorniki": "Komornikach",
    "Konstantynów Łódzki": "Konstantynowie Łódzkim", "Kowale": "Kowalach", "Koziegłowy": "Koziegłowach", "Luboń": "Luboniu", "Mierzyn": "Mierzynie",
    "Mikołów": "Mikołowie", "Monte": "Monte", "Niemcz": "Niemczu", "Osielsko": "Osielsku", "Owińska": "Owińskach",
    "Piekary Śląskie": "Piekarach Śląskich", "Pilchowice": "Pilchowicach", "Plewiska": "Plewiskach", "Przeźmierowo": "Przeźmierowie",
    "Sierosław": "Sierosławiu", "Skórzewo": "Skórzewie", "Suchy Dwór": "Suchym Dworze", "Suchy Las": "Suchym Lesie", "Wiry": "Wirach",
    "Wola Kopcowa": "Woli Kopcowej", "Wysoka": "Wysokiej", "Zgierz": "Zgierzu", "Ruda": "Rudzie", "Wola": "Woli", "Dąbrowa": "Dąbrowie",
    "Nowy": "Nowym", "Nowa": "Nowej", "Stary": "Starym", "Stara": "Starej", "Wielka": "Wielkiej", "Wielki": "Wielkim", "Mały": "Małym",
    "Mała": "Małej", "Dolna": "Dolnej", "Dolny": "Dolnym", "Górna": "Górnej", "Górny": "Górnym", "Suchy": "Suchym", "Sucha": "Suchej",
}
#: Endings in order, how many characters go, what is added; the first that fits counts.
LOCATIVE_ENDINGS = (
    ("owa", 1, "ej"), ("owy", 1, "ym"), ("ska", 1, "iej"), ("cka", 1, "iej"), ("ski", 0, "m"), ("cki", 0, "m"), ("na", 1, "ej"), ("ny", 1, "ym"),
    ("cza", 1, "ej"), ("sza", 1, "ej"), ("ła", 1, "ej"), ("ły", 1, "ym"),
    ("ów", 2, "owie"), ("ław", 0, "iu"), ("in", 0, "ie"), ("yn", 0, "ie"), ("ań", 1, "niu"), ("eń", 1, "niu"), ("uń", 1, "niu"), ("ek", 2, "ku"),
    ("ice", 1, "ach"), ("yce", 1, "ach"), ("la", 1, "i"), ("a", 1, "ie"), ("o", 1, "ie"), ("e", 1, "u"), ("y", 1, "ach"),
    ("k", 0, "u"), ("g", 0, "u"), ("ch", 0, "u"), ("sz", 0, "u"), ("cz", 0, "u"), ("rz", 0, "u"), ("ż", 0, "u"),
    ("", 0, "ie"),
)


def _irregular(text: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in LOCATIVES.items() for x in pair]), text)


def _locative_word(word: Column) -> Column:
    out = F.lit(None)
    for ending, drop, add in reversed(LOCATIVE_ENDINGS):
        out = F.when(word.endswith(ending), F.concat(F.substr(word, F.lit(1), F.length(word) - drop), F.lit(add))).otherwise(out)
    return F.coalesce(_irregular(word), out)


def polish_locative(city: Column) -> Column:
    """The locative of a city's name: the irregular form, else each word's, with spaces and hyphens as they are."""
    name = trimmed(city)
    parts = F.regexp_extract_all(name, F.lit(r"([^\s-]+|\s+|-)"), 1)
    declined = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^(\s+|-)$"), p).otherwise(_locative_word(p))), "")
    return F.coalesce(_irregular(name), F.when(name == "", "ie").otherwise(declined))
