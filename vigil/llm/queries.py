"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, ctw_text, embeddings, jaccard, lexical, packing, phrases, pii, quality, substrings, toxicity, unigram, warc
from vigil.llm.session import table


def _vocabulary(name: str) -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def unigram_pieces() -> list[tuple[str, float]]:
    """Pieces and scores of the SentencePiece file, without its control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids]


def encoder_for_packing(ranks_text: bytes, end: int = 1, special: str = "<|endoftext|>"):
    """Makes, in each worker, the encoder of texts: the ids of byte_bpe_50k.json, which has the same vocabulary as
    these ranks and one special token after them, then the end id."""
    import public_tokenizers

    pattern = public_tokenizers.PATTERN

    def make():
        return _ends(ranks_text, pattern, end, special)

    return make


@lru_cache(maxsize=1)
def _ends(ranks_text: bytes, pattern: str, end: int, special: str):
    ranks = bpe.read_ranks(ranks_text)
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: len(ranks)})

    def to_ids(text: str) -> np.ndarray:
        return np.append(encoding.encode_to_numpy(text, allowed_special="all"), np.uint32(end))

    return to_ids


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw_text.scored(table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.measured(docs, quality.references(docs))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents"), unigram_pieces())


#: Sources are mixed by their tokens to this power: large ones give less than their share until the small run dry.
MIXTURE_POWER = 0.7


def packed_documents(docs: DataFrame) -> DataFrame:
    return packing.packed(packing.tokenised(docs, encoder_for_packing(_vocabulary("byte_bpe_50k.tiktoken"))), temper=MIXTURE_POWER)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"), pii.fit(pii.labelled_table(spark)))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_ctw": op2_ctw,
    "op3_substrings": op3_substrings,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_quality": op5_quality,
    "op6_embeddings": op6_embeddings,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_pii": op11_pii,
    "op12_lexical": op12_lexical,
    "op13_phrases": op13_phrases,
}

#: Phrases by brute force: every gram of every piece.
PHRASES_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents where text is not null),
words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from words),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
  from starts, range(1, 6) as t(k) where i + k - 1 <= len(w) group by all),
totals as (select lang, cast(sum(f) as bigint) as n from grams where k = 1 group by lang),
often as (select * from grams where f >= 100),
longer as (
  select distinct lang, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') as phrase, f
  from often, range(2, 5) as a(m), range(1, 5) as b(i) where m < k and i + m - 1 <= k),
candidates as (
  select lang, phrase, k, f from often o where k > 1 and not exists (
    select 1 from longer x where x.lang = o.lang and x.phrase = o.phrase and 100 * x.f >= 100 * o.f)),
cuts as (
  select c.lang, c.phrase, c.f as a, l.f as l, r.f as r, n, cut,
    cast((1000::hugeint * c.f * n) // (l.f::hugeint * r.f) as bigint) as score
  from candidates c, range(1, 5) as t(cut), often l, often r, totals
  where cut < c.k and l.lang = c.lang and r.lang = c.lang and totals.lang = c.lang
    and l.phrase = array_to_string(string_split(c.phrase, ' ')[1:cut], ' ')
    and r.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:c.k], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
"""

#: The search by brute force: every document against every item.
LEXICAL_SQL = """
with terms as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
  from documents where text is not null),
held as (select doc_id, w, cast(len(w) as bigint) as n from terms where len(w) > 0),
totals as (select count(*) as nd, cast(sum(n) as bigint) as total from held),
tfs as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(w) as term from held) group by all),
asked as (
  select item_id, term, count(*) as q from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark where text is not null) group by all),
weights as (
  select term, cast(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) as bigint) as weight
  from tfs, totals group by term),
scores as (
  select item_id, doc_id, cast(sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // total)))) as bigint) as score
  from asked join tfs using (term) join weights using (term), totals group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scores where score > 0 qualify rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op12_lexical": LEXICAL_SQL, "op13_phrases": PHRASES_SQL}
