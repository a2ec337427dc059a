"""The corpus pipeline: from raw documents to token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.

1. quality_rules: documents that fail the rule table go.
2. simhash_dedup: of each group of documents linked by a Jaccard similarity of 0.8 or
   more of their 5-word shingles, the document with the smallest id stays. Candidates come
   from SimHash fingerprints and their variants, and whole shingle sets are compared.
3. decontaminate: documents with a twentieth of their words inside benchmark passages
   go; of the others such words are cut out.
4. mix_sources: documents are repeated, or left out, until sources meet their weights.
5. sstable_tokens: token ids in sorted tables; per row the place and checksum of its ids.
   A document that the mix takes more than once has as many rows.
"""

from lexivane.llm import decontam, mixing, rules, simhash, sstable
from lexivane.llm.common import run_stages
from lexivane.llm.queries import table, tokenizer_path


def quality_rules(spark, docs, sf_dir):
    return rules.keep_good(docs)


def simhash_dedup(spark, docs, sf_dir):
    return simhash.keep_one(docs, width=5, similarity=0.8)


def decontaminate(spark, docs, sf_dir):
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


def sstable_tokens(spark, docs, sf_dir):
    return sstable.read_tables(sstable.write_tables(docs, tokenizer_path()))


STAGES = [(f.__name__, f) for f in (quality_rules, simhash_dedup, decontaminate, mix_sources, sstable_tokens)]

#: SimHash, pivotal rounding and BPE are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of ``sf_dir``."""
    stages = [(name, lambda docs, stage=stage: stage(spark, docs, sf_dir)) for name, stage in STAGES]
    return run_stages(spark, table(spark, sf_dir, "documents"), stages)
