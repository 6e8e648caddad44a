"""Forms, steps and analyses, and their form as plain JSON values between Spark stages."""

from __future__ import annotations

from dataclasses import dataclass, field

from .languages import is_proto, language_name
from .vocab import NOT_CONTIGUOUS, RELATIONS


@dataclass(frozen=True)
class Form:
    lemma: str
    language: str
    gloss: str | None = None
    transliteration: str | None = None
    variants: tuple[str, ...] = ()

    @property
    def bare(self) -> str:
        return self.lemma.lstrip("*")

    @property
    def reconstructed(self) -> bool:
        return self.lemma.startswith("*") or is_proto(self.language)

    @property
    def key(self) -> tuple[str, str]:
        return self.language, self.bare.casefold()

    @property
    def spellings(self) -> tuple[str, ...]:
        return (self.lemma, *self.variants)

    def pack(self) -> list:
        return [self.lemma, self.language, self.gloss, self.transliteration, list(self.variants)]

    @classmethod
    def unpack(cls, x: list) -> Form:
        return cls(x[0], x[1], x[2], x[3], tuple(x[4]))


@dataclass
class Step:
    relation: str
    forms: list[Form]
    distant: bool = False

    @property
    def named(self) -> list[Form]:
        return [f for f in self.forms if f.lemma]

    def pack(self) -> list:
        return [self.relation, [f.pack() for f in self.forms], self.distant]

    @classmethod
    def unpack(cls, x: list) -> Step:
        return cls(x[0], [Form.unpack(f) for f in x[1]], x[2])


@dataclass
class Hypothesis:
    form: Form
    attribution: str | None = None

    def pack(self) -> list:
        return [self.form.pack(), self.attribution]

    @classmethod
    def unpack(cls, x: list) -> Hypothesis:
        return cls(Form.unpack(x[0]), x[1])


@dataclass
class Analysis:
    steps: list[Step] = field(default_factory=list)
    hypotheses: list[Hypothesis] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    root: Form | None = None
    eponym: str | None = None
    uncertain: bool = False
    imitative: bool = False
    no_etymology_yet: bool = False
    not_a_lemma: bool = False
    prose: str = ""
    text: str = ""

    @property
    def carries_etymology(self) -> bool:
        told = self.steps or self.uncertain or self.root or self.imitative or self.eponym
        return bool(told or (self.text.strip() and not self.not_a_lemma))

    def pack(self) -> dict:
        flags = {k: getattr(self, k) for k in ("eponym", "uncertain", "imitative", "no_etymology_yet", "not_a_lemma", "prose", "text", "notes")}
        return flags | {"steps": [s.pack() for s in self.steps], "hypotheses": [h.pack() for h in self.hypotheses], "root": self.root.pack() if self.root else None}

    @classmethod
    def unpack(cls, x: dict) -> Analysis:
        out = cls(**{k: x[k] for k in ("eponym", "uncertain", "imitative", "no_etymology_yet", "not_a_lemma", "prose", "text")})
        out.notes = list(x["notes"])
        out.steps = [Step.unpack(s) for s in x["steps"]]
        out.hypotheses = [Hypothesis.unpack(h) for h in x["hypotheses"]]
        out.root = Form.unpack(x["root"]) if x["root"] else None
        return out


POINTER, DERIVATION, CONTRACTION = "POINTER", "DERIVATION", "CONTRACTION"


@dataclass
class Statement:
    """What a definition line says of the word: a form of, derived from or contracted from others."""

    kind: str
    wording: str
    forms: list[Form]
    relation: str | None = None
    part_of_speech: str = ""
    gloss: str | None = None

    @property
    def label(self) -> str:
        return " · ".join(x for x in (self.part_of_speech, self.gloss) if x) or self.wording

    def pack(self) -> list:
        return [self.kind, self.wording, [f.pack() for f in self.forms], self.relation, self.part_of_speech, self.gloss]

    @classmethod
    def unpack(cls, x: list) -> Statement:
        return cls(x[0], x[1], [Form.unpack(f) for f in x[2]], *x[3:])


def describe(relation: str, language: str) -> str:
    """A relation with the language it names, as notes put it."""
    label, needs = RELATIONS[relation]
    if not needs:
        return label
    name = language_name(language)
    return f"{label} from an unregistered language ({language})" if name == language else f"{label} from {name}"


def contiguous(relation: str) -> bool:
    return relation not in NOT_CONTIGUOUS
