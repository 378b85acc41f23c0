"""The stages of the pipeline as commands: ``python -m lexweave.commands STAGE ... [--settings FILE]``.

Each stage reads and writes files, so stages may run one after another or be
replaced by other programs.  ``run`` is the same for a given session.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import text as T
from .operators import apply as A
from .operators import cluster as K
from .operators import collocations as C
from .operators import evaluate as E
from .operators import ngrams as N
from .operators import thesaurus as H
from .scratch import save
from .sources import formats as IO


def preprocess(spark: SparkSession, s: config.Settings, source: str, target: str) -> None:
    """Clean every line of text files; blank lines are dropped."""
    IO.write_lines(N.preprocessed(IO.read_corpus(spark, source), s.processor), target)


def count(spark: SparkSession, s: config.Settings, source: str, target: str) -> None:
    """Count the n-grams of text files, a folder ``n=...`` per order."""
    IO.write_counts(N.ngram_counts(N.spread(IO.read_corpus(spark, source)), s.max_ngram_order), target)


def _counts(spark: SparkSession, s: config.Settings, source: str, marker: str | None = None, least: int = 1) -> DataFrame:
    """Counts of all orders in a folder of ``n=...`` folders, or of files by the names of the settings."""
    from .sources.binary import file_system

    store, where = file_system(source)
    out = None
    for n, name in enumerate(s.ngram_count_filenames[: s.max_ngram_order], 1):
        folder = f"n={n}" if store.get_file_info(f"{where}/n={n}").type.name == "Directory" else name
        part = IO.read_counts(spark, f"{source}/{folder}", n, least, marker)
        out = part if out is None else out.unionByName(part)
    return out


def _marker(s: config.Settings) -> str | None:
    return T.MARKER if s.processor in T.MARKING else None


def prune(spark: SparkSession, s: config.Settings, source: str, target: str) -> None:
    """Drop rare n-grams and those with a token that the processor put in."""
    IO.write_counts(_counts(spark, s, source, _marker(s), s.min_count), target)


def collocations(spark: SparkSession, s: config.Settings, target: str, source: str) -> None:
    """Find collocations in the counts of all orders."""
    counts = N.merged_counts(_counts(spark, s, source, _marker(s)))
    counts = save(counts.where(F.col("cnt") >= s.min_count), "counts").df
    IO.write_collocations(C.collocations(counts, s), target)


def apply(spark: SparkSession, s: config.Settings, found: str, source: str, target: str) -> None:
    """Join the words of each collocation in text files."""
    lines = A.apply_collocations(IO.read_corpus(spark, source), IO.read_collocations(spark, found), s.embeddings_case_sensitive)
    IO.write_lines(lines, target)


def thesaurus(spark: SparkSession, s: config.Settings, vectors: str, target: str) -> None:
    """Make a thesaurus of the terms of a binary vector file."""
    made = H.build_thesaurus(IO.read_word2vec(spark, vectors), s)
    IO.write_thesaurus(made, target, s.processor, s.embeddings_case_sensitive)


def trim(spark: SparkSession, s: config.Settings, source: str, target: str, least: str) -> None:
    """Drop entries below an overall score."""
    head = IO.read_thesaurus_header(spark, source)
    IO.write_thesaurus(H.trimmed(IO.read_thesaurus(spark, source), float(least)), target, head["processor"], head["case_sensitive"])


def cluster(spark: SparkSession, s: config.Settings, vocabulary: str, first: str, source: str, k: str, target: str) -> None:
    """Group the first terms of a vocabulary to k clusters by the entries of a thesaurus."""
    terms = save(IO.read_vocabulary(spark, vocabulary, int(first)), "vocabulary").df
    links = H.undirected(IO.read_thesaurus(spark, source)).select("p1", "p2", F.col("overall").alias("score"))
    made = K.representatives(K.cluster_by_count(links, terms.select("form"), int(k)), terms)
    IO.write_clusters(made, target)


def _concepts(spark: SparkSession, s: config.Settings) -> DataFrame:
    return IO.read_concepts(spark, f"{s.metathesaurus_home}/META/MRCONSO.RRF", s.language)


def _abbreviations(spark: SparkSession, s: config.Settings) -> DataFrame:
    return IO.read_abbreviations(spark, f"{s.lexicon_home}/LEX/LRABR")


def concept_experiment(spark: SparkSession, s: config.Settings, vectors: str, target: str) -> None:
    """Score pairs of forms with the same lexical id."""
    pairs = E.concept_experiment(_concepts(spark, s), _abbreviations(spark, s), s)
    IO.write_experiment(E.scored_pairs(pairs, IO.read_word2vec(spark, vectors), s.permutation_penalty), target)


def abbreviation_experiment(spark: SparkSession, s: config.Settings, target: str) -> None:
    """Score abbreviations and their long forms, words in their order."""
    pairs = E.abbreviation_experiment(_abbreviations(spark, s), s)
    IO.write_experiment(E.scored_pairs(pairs, None, None, abbr=True), target)


def random_experiment(spark: SparkSession, s: config.Settings, vectors: str, n: str, target: str) -> None:
    """Score random pairs of forms."""
    pairs = E.random_experiment(_concepts(spark, s), s, int(n))
    IO.write_experiment(E.scored_pairs(pairs, IO.read_word2vec(spark, vectors), s.permutation_penalty, abbr=True), target)


def npmi_experiment(spark: SparkSession, s: config.Settings, source: str, target: str) -> None:
    """Score the concept forms by the counts of all orders."""
    counts = N.merged_counts(_counts(spark, s, source, _marker(s)))
    counts = save(counts.where(F.col("cnt") >= s.min_count), "counts").df
    IO.write_npmi(E.npmi_experiment(_concepts(spark, s), counts, s), target)


def concept_evaluation(spark: SparkSession, s: config.Settings, source: str, target: str) -> None:
    """Label the entries of a thesaurus by whether both forms share a concept."""
    clean = T.processor(s.processor)
    concepts = IO.read_concepts(spark, f"{s.metathesaurus_home}/META/MRCONSO.RRF", s.language, lambda c: F.trim(clean(c)))
    IO.write_labelled_pairs(E.concept_pairs(IO.read_thesaurus(spark, source), concepts), target)


def analyse(spark: SparkSession, s: config.Settings, source: str) -> None:
    """Print the means of an experiment's scores."""
    t = IO.read_experiment(spark, source)
    print(E.mean_known(t, *t.columns[2:]).first().asDict())


STAGES = {
    f.__name__.replace("_", "-"): (f, arguments)
    for f, arguments in (
        (preprocess, "source target"), (count, "source target"), (prune, "source target"), (collocations, "target source"), (apply, "found source target"),
        (thesaurus, "vectors target"), (trim, "source target least"), (cluster, "vocabulary first source k target"),
        (concept_experiment, "vectors target"), (abbreviation_experiment, "target"), (random_experiment, "vectors n target"),
        (npmi_experiment, "source target"), (concept_evaluation, "source target"), (analyse, "source"),
    )
}


def run(spark: SparkSession, arguments: list[str], settings: config.Settings | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexweave", description=__doc__.partition("\n")[0])
    stages = parser.add_subparsers(dest="stage", required=True)
    for name, (f, names) in STAGES.items():
        stage = stages.add_parser(name, help=f.__doc__.partition("\n")[0])
        for x in names.split():
            stage.add_argument(x)
        stage.add_argument("--settings", help="file of key=value lines")
    given = vars(parser.parse_args(arguments))
    f, names = STAGES[given["stage"]]
    s = config.load(given["settings"]) if given["settings"] else settings or config.Settings()
    f(spark, s, *[given[x] for x in names.split()])


def main() -> None:
    import sys

    run(SparkSession.builder.appName("lexweave").getOrCreate(), sys.argv[1:])


if __name__ == "__main__":
    main()
