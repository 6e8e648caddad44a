"""``python -m stemma.cli WORD --pages PATH``: one word's history from a page table."""

from __future__ import annotations

import argparse
import os
import sys

from .functions.languages import is_known
from .operators import views

#: Exit codes; 2 is argparse's, for a wrong command line.
FOUND, WRONG, NOT_FOUND, UNREACHABLE = 0, 1, 3, 4

EXPLAINED = {
    "ENTRY_MISSING": "There is no page «{word}» among these pages. Is it spelt so, and is --language right?",
    "LANGUAGE_MISSING": "The page «{word}» has no section for «{language}»; --language names another.",
    "FORM_NOT_GIVEN": "The entry «{word}» names the language of its source, but not the form.",
    "ETYMOLOGY_MISSING": "The entry «{word}» records no etymology that can be read.",
    "NOT_INTERPRETED": "The entry «{word}» tells its origin in prose only, shown as it stands.",
}


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="stemma", description="The history of a word, from a table of wiki pages.")
    p.add_argument("word", nargs="?")
    p.add_argument("--pages", help="a Parquet folder with title and wikitext")
    p.add_argument("-l", "--language", default="it")
    p.add_argument("-s", "--sense", type=int)
    p.add_argument("--senses", action="store_true", help="list the homographs")
    p.add_argument("-d", "--depth", type=int, default=12)
    how = p.add_mutually_exclusive_group()
    how.add_argument("-c", "--chain", action="store_true")
    how.add_argument("-j", "--json", action="store_true")
    p.add_argument("--no-compounds", action="store_true")
    p.add_argument("--as", dest="as_lemma", metavar="LEMMA")
    p.add_argument("--as-written", action="store_true", help="do not look an inflected form up under its lemma")
    p.add_argument("--cache-ttl", type=float, default=30.0)
    p.add_argument("--cache", help="the folder of the page cache")
    for name in ("clear", "prune"):
        p.add_argument(f"--{name}-cache", action="store_true")
    p.add_argument("--cache-stats", action="store_true")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("-V", "--version", action="version", version="0.1")
    return p.parse_args(argv)


def problem(a: argparse.Namespace) -> str | None:
    if not 1 <= a.depth <= 100:
        return "the depth must be from 1 to 100"
    if a.cache_ttl < 0:
        return "the lifetime of pages can't be negative"
    if not is_known(a.language):
        return f"«{a.language}» is not in the table of languages"
    return None


def _cache(spark, a: argparse.Namespace) -> int:
    from .sources.cache import PageCache

    cache = PageCache(spark, a.cache, a.cache_ttl)
    if a.clear_cache:
        done, message = cache.clear()
        print(message)
        return FOUND if done else WRONG
    print("{} pages{}, {:.2f} MB".format(*((cache.prune()[0], " removed", cache.stats()[1]) if a.prune_cache else (cache.stats()[0], "", cache.stats()[1]))))
    return FOUND


def look_up(engine, a: argparse.Namespace, word: str) -> int:
    """Print one word's history; diagnostics go to the other stream."""
    from .operators.walk import SourceError

    try:
        found = engine.senses(word, a.language) if a.senses or a.sense is None else []
        if a.senses:
            print(views.senses_menu(word, found))
            return FOUND if found else NOT_FOUND
        told = [s for s in found if s[5]]
        sense = a.sense or (told[0][0] if told else 1)
        if len(told) > 1:
            print(f"{len(told)} etymologies; following number {sense} (--sense chooses)", file=sys.stderr)
        result = engine.reconstruct(word, a.language, sense=sense, follow_lemma=not a.as_written, as_lemma=a.as_lemma)
    except SourceError as e:
        print(f"{e} could not be fetched", file=sys.stderr)
        return UNREACHABLE
    if len(result.history.options) > 1 and not a.as_lemma:
        print(views.targets_menu(word, result.history.options), file=sys.stderr)
    root = result.history.rows[0]
    barren = len(result.history.rows) == 1 and root.terminal is not None and not views.V.TERMINALS[root.terminal][2]
    quiet = barren and not root.source_text and root.terminal != "FORM_NOT_GIVEN"
    color = not a.no_color and "NO_COLOR" not in os.environ and os.environ.get("TERM") != "dumb" and sys.stdout.isatty()
    if a.json:
        print(result.json(senses=told if len(told) > 1 else None))
    elif not quiet:
        print(result.chain(color) if a.chain else result.tree(color))
    if barren:
        print(EXPLAINED.get(root.terminal, "Nothing is told of «{word}».").format(word=word, language=a.language), file=sys.stderr)
    return NOT_FOUND if barren else FOUND


def converse(engine, a: argparse.Namespace) -> int:
    """A word a line, or ``:l CODE`` for another language; an empty line or ``:q`` ends."""
    code = FOUND
    for line in sys.stdin:
        word = line.strip()
        if word in ("", ":q"):
            break
        if word.startswith(":l "):
            if is_known(word[3:].strip()):
                a.language = word[3:].strip()
            else:
                print(f"«{word[3:].strip()}» is not in the table of languages", file=sys.stderr)
            continue
        code = look_up(engine, a, word)
    return code


def main(argv: list[str] | None = None, spark=None) -> int:
    a = arguments(argv)
    wrong = problem(a)
    upkeep = a.clear_cache or a.prune_cache or a.cache_stats
    if not wrong and not upkeep and not a.pages:
        wrong = "--pages is needed"
    if wrong:
        print(wrong, file=sys.stderr)
        return WRONG
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if upkeep:
        return _cache(spark, a)
    from .engine import Engine
    from .sources.pages import from_files

    engine = Engine(spark, from_files(spark, a.pages), max_depth=a.depth, follow_compounds=not a.no_compounds)
    return look_up(engine, a, a.word) if a.word else converse(engine, a)


if __name__ == "__main__":
    sys.exit(main())
