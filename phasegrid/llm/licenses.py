"""License scans: notices matched word for word against templates with optional and replaceable regions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from phasegrid.llm.common import id_and_text, map_texts

#: Phrases of the base scan and their labels (fixed values).
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices in template markup: ``<<beginOptional>> words <<endOptional>>`` may be missing, ``<<var;match=N>>`` stands for
#: up to N words of any kind. Public license names and notices.
TEMPLATES = {
    "mit": (
        "under the <<beginOptional>>terms of the<<endOptional>> MIT <<beginOptional>>X11 <<endOptional>>License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the <<var;match=2>>), to deal in the <<var;match=2>> without restriction",
    ),
    "apache-2": (
        "under the <<beginOptional>>terms of the<<endOptional>> Apache <<beginOptional>>Software<<endOptional>> License "
        "<<beginOptional>>, Version<<endOptional>> 2<<beginOptional>>.0<<endOptional>>",
    ),
    "gpl-3": (
        "GNU General Public License <<beginOptional>>as published by the Free Software Foundation; either<<endOptional>> "
        "<<beginOptional>>,<<endOptional>> version 3",
    ),
    "gpl-2": (
        "GNU General Public License <<beginOptional>>as published by the Free Software Foundation; either<<endOptional>> "
        "<<beginOptional>>,<<endOptional>> version 2",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "under the <<beginOptional>>terms of the<<endOptional>> <<var;match=1>> BSD <<var;match=2>> License",
    ),
    "cc-by-nc": (
        "<<beginOptional>>licensed<<endOptional>> under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> "
        "CC BY-NC <<beginOptional>><<var;match=2>><<endOptional>> 4.0",
        "Creative Commons Attribution NonCommercial <<beginOptional>><<var;match=3>><<endOptional>> License",
    ),
}

ASCII_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MARKUP = re.compile(r"<<(beginOptional|endOptional|var;match=(\d+))>>")


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and other letters, as UTF-8."""
    return text.encode().translate(ASCII_WORD).split()


@dataclass
class Automaton:
    """States joined by words. ``steps[s]`` maps a word to the next states, ``free[s]`` are reached by any word."""

    label: str
    steps: list[dict[bytes, set[int]]] = field(default_factory=lambda: [{}])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    starts: set[int] = field(default_factory=lambda: {0})
    accepting: set[int] = field(default_factory=set)

    def state(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def after(self, states: set[int], word: bytes) -> set[int]:
        out: set[int] = set()
        for s in states:
            out |= self.steps[s].get(word, set()) | self.free[s]
        return out

    def first_words(self) -> set[bytes]:
        return {w for s in self.starts for w in self.steps[s]}


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of one template. Replaceable words are counted, so its size is that of the template."""
    auto = Automaton(label)
    ends, opened, at = {0}, [], 0
    for m in [*MARKUP.finditer(template), None]:
        for word in words_of(template[at : m.start() if m else len(template)]):
            new = auto.state()
            for s in ends:
                auto.steps[s].setdefault(word, set()).add(new)
            ends = {new}
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            opened.append(ends)
        elif m[1] == "endOptional":
            ends = ends | opened.pop()
        else:
            reached = set(ends)
            for _ in range(int(m[2])):
                new = auto.state()
                for s in ends:
                    auto.free[s].add(new)
                ends = {new}
                reached.add(new)
            ends = reached
    if opened:
        raise ValueError(f"an optional region of {label} has no end")
    auto.accepting = ends
    if auto.starts & ends or any(auto.free[s] for s in auto.starts):
        raise ValueError(f"a template of {label} has to begin with wording")
    return auto


def compile_all(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> list[Automaton]:
    return [compile_template(label, t) for label, each in templates.items() for t in each]


def base_places(words: list[bytes], phrases) -> list[tuple[int, int, str]]:
    """(start, end, label) of every place where the words of a phrase stand one after the other."""
    line, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        wanted = phrase.encode()
        at = line.find(b" " + wanted + b" ")
        while at >= 0:
            start = line.count(b" ", 0, at)
            found.append((start, start + phrase.count(" ") + 1, label))
            at = line.find(b" " + wanted + b" ", at + 1)
    return found


def template_places(words: list[bytes], automata: list[Automaton]) -> list[tuple[int, int, str]]:
    """(start, end, label) of the longest match from every start of every template."""
    present, found = set(words), []
    for auto in automata:
        first = auto.first_words() & present
        if not first:
            continue
        for start, word in enumerate(words):
            if word not in first:
                continue
            states, at, end = auto.starts, start, -1
            while states and at < len(words):
                states = auto.after(states, words[at])
                at += 1
                if states & auto.accepting:
                    end = at
            if end > 0:
                found.append((start, end, auto.label))
    return found


def scan_licenses(docs: DataFrame, phrases=BASE, templates=TEMPLATES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: word count, places and labels of the base phrases, labels with the templates', score.

    ``score`` is the share of the words that lie in matched wording. A null or empty text has 0 words, no label (empty
    strings), null places and score 0; repeated rows are judged alike; a null id stays null. One narrow stage.
    """
    rare = None if templates is not TEMPLATES else (b"licen", b"permission", b"redistribution", b"gnu", b"cc by")

    def run(ids, texts):
        automata = compile_all(templates)
        out = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")} | {"doc_id": ids}
        for value in texts:
            words = words_of(value or "")
            line = b" ".join(words)
            base = base_places(words, phrases) if any(p.split()[0].encode() in line for p, _ in phrases) else []
            more = template_places(words, automata) if rare is None or any(r in line for r in rare) else []
            covered: set[int] = set()
            for a, b, _ in base + more:
                covered.update(range(a, b))
            starts = [a for a, _, _ in base]
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(min(starts, default=None))
            out["last_word"].append(max(starts, default=None))
            out["base_labels"].append(",".join(sorted({x for _, _, x in base})))
            out["labels"].append(",".join(sorted({x for _, _, x in base + more})))
            out["score"].append(len(covered) / len(words) if words else 0.0)
        return out

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
    return map_texts(id_and_text(docs, key, text), run, schema)
