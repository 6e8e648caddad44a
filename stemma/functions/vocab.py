"""Vocabularies of the data model, as plain tables and as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Relations. name | label | needs a language
RELATIONS = {
    "INHERITED": ("inherited", True),
    "BORROWED": ("borrowed", True),
    "UNADAPTED_BORROWING": ("borrowed unadapted", True),
    "LEARNED_BORROWING": ("learned borrowing", True),
    "SEMI_LEARNED_BORROWING": ("semi-learned borrowing", True),
    "ORTHOGRAPHIC_BORROWING": ("orthographic borrowing", True),
    "CALQUE": ("calqued", True),
    "PARTIAL_CALQUE": ("partially calqued", True),
    "SEMANTIC_LOAN": ("semantic loan", True),
    "DERIVED": ("derived", True),
    "ROOT": ("root in", True),
    "COMPOUND": ("compound of", False),
    "AFFIXATION": ("formed with affixes from", False),
    "DIMINUTIVE": ("diminutive of", False),
    "AUGMENTATIVE": ("augmentative of", False),
    "CLIPPING": ("clipping of", False),
    "ABBREVIATION": ("abbreviation of", False),
    "BACK_FORMATION": ("back-formation from", False),
    "DEVERBAL": ("deverbal of", False),
    "DENOMINAL": ("denominal of", False),
    "NOMINALIZATION": ("nominalization of", False),
    "CAUSATIVE": ("causative of", False),
    "REDUPLICATION": ("reduplication of", False),
    "METATHESIS": ("metathesis of", False),
    "REBRACKETING": ("rebracketing of", False),
    "VARIANT": ("variant of", False),
}
NOT_CONTIGUOUS = {"DERIVED", "ROOT"}

# Terminals. name | symbol | label | a fact about the language | a reserve may go on instead
TERMINALS = {
    "RECONSTRUCTED_FORM": ("√", "reconstructed form", True, False),
    "RECONSTRUCTED_ROOT": ("√", "reconstructed root", True, False),
    "IMITATIVE": ("≈", "imitative origin", True, False),
    "EPONYM": ("≡", "named after a person or place", True, False),
    "UNCERTAIN_ORIGIN": ("⊗", "uncertain origin", True, False),
    "DATA_EXHAUSTED": ("·", "data exhausted", True, True),
    "ALREADY_SHOWN": ("=", "already shown above", True, False),
    "FORM_NOT_GIVEN": ("◌", "source names the language, not the form", False, True),
    "ENTRY_MISSING": ("?", "no Wiktionary entry", False, True),
    "LANGUAGE_MISSING": ("?", "language not covered by the entry", False, True),
    "ETYMOLOGY_MISSING": ("?", "no etymology recorded", False, True),
    "NOT_INTERPRETED": ("?", "etymology not interpreted", False, True),
    "DEPTH_LIMIT": ("↓", "depth limit reached", False, False),
    "CYCLE": ("↺", "circular reference", False, False),
    "NETWORK_ERROR": ("!", "data not retrievable", False, True),
}
ABSENCES = frozenset(name for name, row in TERMINALS.items() if row[3])

# Template names by relation. Linear ones carry language, lemma, display and gloss in parameters 2 to 5.
_LINEAR = """
INHERITED: inh, inherited
BORROWED: bor, borrowed, abor, adapted borrowing, psm, phono-semantic matching, translit, transliteration
UNADAPTED_BORROWING: ubor, unadapted borrowing
LEARNED_BORROWING: lbor, learned borrowing
SEMI_LEARNED_BORROWING: slbor, slb, semi-learned borrowing
ORTHOGRAPHIC_BORROWING: obor, orthographic borrowing
CALQUE: cal, calque, clq
PARTIAL_CALQUE: pcal, pclq, partial calque
SEMANTIC_LOAN: sl, semantic loan
DERIVED: der, derived, uder, der?, undefined derivation
"""
_FORMATION = """
AFFIXATION: af, affix, suf, suffix, pre, pref, prefix, infix, con, confix
COMPOUND: com, compound, blend, blend of, univerbation, univ, clipped compound, clipcomp, it-verb-obj, it-verb-verb
CLIPPING: clipping, clip, clipping of, short for, shortening, sh, ellipsis, ellip, ellipsis of, apheretic form, apocopic form, apocopic form of, syncopic form, sync, prothetic form, contraction, contr, contraction of
ABBREVIATION: abbreviation, abbrev, abbreviation of, acronym, acro, acronym of, initialism, init, initialism of, syllabic abbreviation, sylabbr
BACK_FORMATION: back-form, backform, backformation, back-formation, back formation, back-formation of, bf, b-f
DEVERBAL: deverbal, deverbative, it-deverbal, it-deverbal fpp
DENOMINAL: denominal verb
NOMINALIZATION: nominalization, nom
CAUSATIVE: causative
REDUPLICATION: reduplication, rdp, redup
METATHESIS: metathesis
REBRACKETING: rebracketing
VARIANT: alt form, alternative form of
"""
_REMARKS = """
synchronically analysable as: surf, surface analysis, surface etymology
pseudo-loan modelled on: pseudo-loan, pl, pseudoloan
pseudo-acronym: pseudo-acronym
an internationalism: internationalism, intnat
deliberately coined: coinage, coin, coined
from a genericised trademark: genericized trademark, gentrade
displaced an earlier term: displaced
with a shift in meaning: semantic shift, ss
resembles, without being related to: false cognate, fcog
partial doublet of: piecewise doublet, pw dbt, pwdbt
etymology under discussion: rfv-etym, rfve, rfv-ety
literally: lit, literally
"""
# Templates of definition lines that point to another word, with their wording where it differs.
_POINTERS = """
past participle of
present participle of
plural of
singular of
feminine of
feminine singular of
feminine plural of
masculine plural of
female equivalent of
inflection of: inflection of, infl of
verb form of
adjective form of: adj form of
gerund of
verbal noun of
superlative of
elative of
apocopic form of: apocopic form of, apoc of
syncopic form of: syncopic form of, sync of
apheretic form of
contraction of
abbreviation of: abbreviation of, abbr of
short for
ellipsis of: ellipsis of, ellip of
alternative form of: alternative form of, alt form
alternative spelling of: alternative spelling of, alt sp, alt sp of
alternative case form of
medieval spelling of
obsolete spelling of: obsolete spelling of, obs sp
obsolete form of: obsolete form of, obs form of
archaic spelling of
archaic form of
pronunciation spelling of
misspelling of
informal form of
euphemistic form of
form of
not a lemma: nonlemma
"""
_DERIVATIONS = """
DIMINUTIVE: diminutive of, dim of
AUGMENTATIVE: augmentative of, aug of
"""


def _by_name(rows: str) -> dict[str, str]:
    out = {}
    for line in rows.strip().splitlines():
        value, _, names = line.partition(": ")
        for name in (names or value).split(", "):
            out[name.strip()] = value
    return out


LINEAR, FORMATION, REMARKS = _by_name(_LINEAR), _by_name(_FORMATION), _by_name(_REMARKS)
POINTERS, DERIVATIONS = _by_name(_POINTERS), _by_name(_DERIVATIONS)

# Marker templates.
FROM_FIRST = {"it-deverbal", "it-deverbal fpp", "it-verb-obj", "it-verb-verb", "ja-compound", "ja-com", "com-ja", "ja-blend", "sa-af", "sa-com"}
UNCERTAIN = {"unk", "unknown", "unc", "uncertain", "unknown origin"}
IMITATIVE = {"onom", "onomatopoeic", "onomatopeic", "onomatopoeia", "imitative", "sound symbolic", "sound-symbolic"}
EPONYM = {"named after", "named-after", "eponym"}
NO_ETYMOLOGY_YET = {"rfe", "request for etymology", "rfetym", "rfety", "etystub"}
NOT_A_LEMMA = {"nonlemma", "nonlemmas", "non-lemma", "nl"}
MENTIONS = {"m", "l", "mention", "link", "cog", "cognate", "ncog", "noncog", "noncognate", "cog-lite", "ncog-lite", "noncog-lite"}
PROMOTABLE = {"m", "l", "mention", "link"}
DOUBLETS = {"doublet", "dbt"}
STRUCTURED = {"ety", "etymon"}
NEVER_FOLLOWED = {"synonym of", "syn of", "syn"}
CONTRACTIONS = {"contraction of", "contr of"}
PARTS_OF_SPEECH = frozenset(
    "noun,verb,adjective,adverb,pronoun,preposition,conjunction,interjection,article,numeral,determiner,particle,prefix,suffix,infix,interfix,circumfix,proper noun,participle,contraction,abbreviation,acronym,initialism,symbol,letter,phrase,proverb,idiom,prepositional phrase,adjectival phrase,adverbial phrase,postposition,classifier,counter,root,affix".split(",")
)

# Languages. code | name | first and last year of attestation, 2100 for living ones
_LANGUAGES = """
it|Italian|1200|2100
roa-oit|Old Italian|900|1500
la|Latin|-600|900
la-lat|Late Latin|200|700
la-med|Medieval Latin|600|1500
la-vul|Vulgar Latin|100|900
la-ecc|Ecclesiastical Latin|200|2100
la-eme|Early Medieval Latin|500|1000
la-cla|Classical Latin
la-new|New Latin|1500|2100
itc-ola|Old Latin|-700|-100
itc-pro|Proto-Italic|-2000|-700
ine-pro|Proto-Indo-European|-4500|-2500
vec|Venetan|1200|2100
nap|Neapolitan|1200|2100
scn|Sicilian|1200|2100
lmo|Lombard
pms|Piedmontese
lij|Ligurian
egl|Emilian
rgn|Romagnol
sc|Sardinian
fur|Friulian
co|Corsican
roa-tar|Tarantino
grc|Ancient Greek|-800|400
grk-pro|Proto-Hellenic|-2500|-1600
el|Greek|1450|2100
gkm|Byzantine Greek|400|1450
he|Hebrew|-1200|2100
hbo|Biblical Hebrew|-1200|-200
arc|Aramaic|-900|700
syc|Classical Syriac|100|1300
ar|Arabic|400|2100
xcl|Old Armenian|400|1100
hy|Armenian|1100|2100
cop|Coptic|200|1500
egy|Egyptian|-3000|400
akk|Akkadian|-2500|-100
sux|Sumerian|-3000|-1800
phn|Phoenician|-1200|-300
xpu|Punic
ett|Etruscan|-700|100
xrr|Raetic
xlg|Ligurian (ancient)
osc|Oscan|-500|100
xum|Umbrian|-500|100
sem-pro|Proto-Semitic|-4000|-3000
afa-pro|Proto-Afro-Asiatic
gem-pro|Proto-Germanic|-500|200
gmw-pro|Proto-West Germanic|0|400
got|Gothic|300|700
lng|Lombardic|500|1000
frk|Frankish|400|900
goh|Old High German|700|1050
gmh|Middle High German|1050|1350
de|German|1350|2100
nl|Dutch|1500|2100
dum|Middle Dutch|1150|1500
odt|Old Dutch|500|1150
gml|Middle Low German|1200|1600
osx|Old Saxon|800|1200
ang|Old English|450|1150
enm|Middle English|1150|1500
en|English|1500|2100
non|Old Norse|700|1350
is|Icelandic|1350|2100
sv|Swedish|1350|2100
da|Danish|1350|2100
no|Norwegian|1350|2100
fr|French|1500|2100
fro|Old French|800|1400
frm|Middle French|1300|1650
nrf|Norman
pro|Old Occitan|800|1500
oc|Occitan|1500|2100
ca|Catalan|1000|2100
es|Spanish|1200|2100
osp|Old Spanish|900|1500
pt|Portuguese|1200|2100
roa-opt|Old Portuguese|900|1500
ro|Romanian|1500|2100
cel-pro|Proto-Celtic|-1300|-800
ga|Irish|1200|2100
sga|Old Irish|600|900
cy|Welsh|1000|2100
gaul|Gaulish|-500|500
cel-gau|Gaulish
xtg|Transalpine Gaulish
xcg|Cisalpine Gaulish
xlp|Lepontic
br|Breton|1200|2100
sla-pro|Proto-Slavic|-500|500
cu|Old Church Slavonic|850|1700
ru|Russian|1000|2100
pl|Polish|1000|2100
cs|Czech|1000|2100
sh|Serbo-Croatian|1000|2100
bg|Bulgarian|1000|2100
sl|Slovene|1000|2100
bsl-pro|Proto-Balto-Slavic
lt|Lithuanian|1500|2100
lv|Latvian|1500|2100
hu|Hungarian
fi|Finnish
et|Estonian
urj-pro|Proto-Uralic
sa|Sanskrit|-1500|600
inc-pro|Proto-Indo-Aryan|-2000|-1500
iir-pro|Proto-Indo-Iranian|-2500|-2000
ira-pro|Proto-Iranian|-2000|-1500
pal|Middle Persian|200|900
peo|Old Persian|-600|-300
fa|Persian|1600|2100
fa-cls|Classical Persian|900|1600
hi|Hindi|1300|2100
ur|Urdu|1300|2100
bn|Bengali|1300|2100
ta|Tamil
sd|Sindhi
ae|Avestan|-1200|-400
ota|Ottoman Turkish|1300|1930
gsw|Swiss German
bar|Bavarian
nci|Classical Nahuatl
xaa|Andalusian Arabic
sqr|Siculo-Arabic
grc-koi|Koine Greek
roa-oca|Old Catalan
oc-pro|Proto-Occitan
roa-git|Judeo-Italian
xno|Anglo-Norman
tr|Turkish|1930|2100
trk-pro|Proto-Turkic|-500|500
mn|Mongolian
zh|Chinese
ltc|Middle Chinese
ja|Japanese
ko|Korean
ms|Malay
sw|Swahili
eu|Basque
mt|Maltese|1500|2100
sq|Albanian
kmr|Northern Kurdish
dra|Dravidian
dra-pro|Proto-Dravidian
aav|Austroasiatic
aav-pro|Proto-Austroasiatic
map-pro|Proto-Austronesian
tai-pro|Proto-Tai
nah|Nahuatl
qu|Quechua
tpw|Old Tupi
car|Galibi Carib
ine|Indo-European
ira|Iranian
iir|Indo-Iranian
gem|Germanic
sla|Slavic
cel|Celtic
sem|Semitic
roa|Romance
itc|Italic
trk|Turkic
qfa-sub|Substrate
mul|Translingual
und|Undetermined
"""
LANGUAGES: dict[str, str] = {}
SPANS: dict[str, tuple[int, int]] = {}
for _line in _LANGUAGES.strip().splitlines():
    _code, _name, *_span = _line.split("|")
    LANGUAGES[_code] = _name
    if _span:
        SPANS[_code] = (int(_span[0]), int(_span[1]))
# Where an entry does not separate a language, the section it is read under.
FALLBACKS = {"la-lat": "la", "la-med": "la", "la-vul": "la", "la-ecc": "la", "la-eme": "la", "la-cla": "la", "la-new": "la", "itc-ola": "la", "grc-koi": "grc", "gkm": "el"}
# Languages whose titles have no vowel signs, and those whose titles have no vowel length.
UNVOCALISED = frozenset({"ar", "ota", "fa", "fa-cls", "ur", "ps", "sd", "kmr", "he", "hbo", "arc", "syc", "phn"})
NO_LENGTH = frozenset({"la", "la-lat", "la-med", "la-vul", "la-ecc", "la-new", "itc-ola", "grc"})


def languages_df(spark: SparkSession) -> DataFrame:
    rows = [(c, n, *SPANS.get(c, (None, None)), FALLBACKS.get(c)) for c, n in LANGUAGES.items()]
    return spark.createDataFrame(rows, "code string, name string, attested_from int, attested_to int, fallback_code string")


def relations_df(spark: SparkSession) -> DataFrame:
    rows = [(n, label, needs, n not in NOT_CONTIGUOUS) for n, (label, needs) in RELATIONS.items()]
    return spark.createDataFrame(rows, "name string, label string, needs_language boolean, implies_contiguity boolean")


def terminals_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *row) for n, row in TERMINALS.items()], "name string, symbol string, label string, is_linguistic boolean, is_absence boolean")


def templates_df(spark: SparkSession) -> DataFrame:
    kinds = (("linear", LINEAR), ("formation", FORMATION), ("remark", REMARKS), ("pointer", POINTERS), ("derivation", DERIVATIONS))
    rows = [(n, k, v) for k, names in kinds for n, v in names.items()]
    marks = {"uncertain": UNCERTAIN, "imitative": IMITATIVE, "eponym": EPONYM, "no_etymology_yet": NO_ETYMOLOGY_YET, "not_a_lemma": NOT_A_LEMMA, "mention": MENTIONS, "doublet": DOUBLETS, "structured": STRUCTURED}
    rows += [(n, k, None) for k, names in marks.items() for n in sorted(names)]
    return spark.createDataFrame(rows, "name string, class string, value string")
