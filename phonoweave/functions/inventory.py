"""Symbol tables of our own: a phonetic one, and one of the letters a-z for plain text."""

from __future__ import annotations

from .features import SymbolTable

PHONETIC_FEATURES = "syl son cons cont delrel lat nas voi sg cor ant distr lab hi lo back front tense round long stres prim".split()

#: symbol: features that are +; after a bar those that are unspecified; all others are -.
_PHONES = """
p: cons lab | ant cor tense stres prim
b: cons lab voi | ant cor tense stres prim
t: cons cor ant | tense stres prim
d: cons cor ant voi | tense stres prim
k: cons hi back | ant cor tense stres prim
ɡ: cons hi back voi | ant cor tense stres prim
q: cons back | ant cor tense stres prim
c: cons hi front | ant cor tense stres prim
ɟ: cons hi front voi | ant cor tense stres prim
ʔ: | ant cor tense stres prim
t͡s: cons cor ant delrel | tense stres prim
t͡ʃ: cons cor distr delrel | tense stres prim
f: cons cont delrel lab ant | cor tense stres prim
v: cons cont delrel lab ant voi | cor tense stres prim
ʍ: cons cont delrel lab | ant cor tense stres prim
β: cons cont delrel lab voi | ant cor tense stres prim
θ: cons cont delrel cor ant distr | tense stres prim
ð: cons cont delrel cor ant distr voi | tense stres prim
s: cons cont delrel cor ant front | tense stres prim
z: cons cont delrel cor ant front voi | tense stres prim
ʃ: cons cont delrel cor distr | tense stres prim
x: cons cont delrel hi back | ant cor tense stres prim
ɣ: cons cont delrel hi back voi | ant cor tense stres prim
ʝ: cons cont delrel hi front voi | ant cor tense stres prim
h: cont delrel | ant cor tense stres prim
m: cons son nas lab voi | delrel ant cor tense stres prim
n: cons son nas cor ant voi | delrel tense stres prim
ŋ: cons son nas hi back voi | delrel ant cor tense stres prim
l: cons son cont lat cor ant voi | delrel tense stres prim
ʎ: cons son cont lat hi front voi | delrel ant cor tense stres prim
r: cons son cont cor ant voi | delrel tense stres prim
ɾ: cons son cor ant voi | delrel tense stres prim
j: son cont hi front voi tense | delrel ant cor stres prim
w: son cont hi back round lab voi tense | delrel ant cor stres prim
i: syl son cont hi front voi tense | delrel ant cor
ɪ: syl son cont hi front voi | delrel ant cor
ɨ: syl son cont hi voi | delrel ant cor
u: syl son cont hi back round lab voi tense | delrel ant cor
ʊ: syl son cont hi back round lab voi | delrel ant cor
e: syl son cont front voi tense | delrel ant cor
ɛ: syl son cont front voi | delrel ant cor
ə: syl son cont voi | delrel ant cor
o: syl son cont back round lab voi tense | delrel ant cor
ɔ: syl son cont back round lab voi | delrel ant cor
a: syl son cont lo voi | delrel ant cor
ɑ: syl son cont lo back voi | delrel ant cor
"""

_IMPLICATIONS = ("+syl:+son,-cons", "-cons:-lat", "+lat:+cons,-nas", "+son:0delrel,+voi", "+nas:+son", "+prim:+stres", "-stres:-prim", "+hi:-lo", "+lo:-hi", "-cont:-long")

_DIACRITICS = ("ʰ=+sg $ aspirated", "ʲ=+hi,+front", "ˠ=+back", "ʷ=+lab,+round", "̃=+nas", "ː=+long", "ˈ=+stres,+prim", "ˌ=+stres,-prim")

LETTER_FEATURES = "syl son nas lat voi cont lab cor dor strid hi lo back round odd".split()

_LETTERS = """
a: syl son voi cont lo
e: syl son voi cont
i: syl son voi cont hi
o: syl son voi cont back round
u: syl son voi cont hi back round
y: son voi cont hi
w: son voi cont hi back round lab
m: son nas voi lab
n: son nas voi cor
l: son lat voi cont cor
r: son voi cont cor
p: lab
b: lab voi
t: cor
d: cor voi
k: dor
g: dor voi
f: lab cont
v: lab cont voi
s: cor cont strid
z: cor cont strid voi
c: cor strid
j: cor strid voi
h: cont lo
q: dor back
x: dor cont odd
"""


def _table(features: list[str], text: str, implications=(), diacritics=()) -> SymbolTable:
    table = SymbolTable(list(features))
    for line in text.strip().splitlines():
        symbol, _, rest = line.partition(":")
        plus, _, none = rest.partition("|")
        plus, none = plus.split(), none.split()
        table.define(symbol.strip(), "".join("2" if f in plus else "1" if f in none else "0" for f in features))
    table.check_symbols()
    table.read_implications(implications)
    table.read_diacritics(diacritics)
    return table


def phonetic_table() -> SymbolTable:
    return _table(PHONETIC_FEATURES, _PHONES, _IMPLICATIONS, _DIACRITICS)


def letter_table() -> SymbolTable:
    return _table(LETTER_FEATURES, _LETTERS)
