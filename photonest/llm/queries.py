"""The queries of the text operators and the SQL for those that SQL can express."""

from __future__ import annotations

from photonest.llm import exact_dedup
from photonest.llm.bpe import op6_bpe_merge_replay
from photonest.llm.exact_dedup import op8_exact_dedup
from photonest.llm.flac import op2_flac_media
from photonest.llm.language import op1_language_mixture
from photonest.llm.mixing import op7_mix_sources
from photonest.llm.pii import op4_contextual_pii
from photonest.llm.simhash import op3_simhash_dedup
from photonest.llm.suffix_dedup import op9_suffix_dedup
from photonest.llm.token_store import op5_token_store
from photonest.llm.toxicity import op10_toxic_spans

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_mixture,
        op2_flac_media,
        op3_simhash_dedup,
        op4_contextual_pii,
        op5_token_store,
        op6_bpe_merge_replay,
        op7_mix_sources,
        op8_exact_dedup,
        op9_suffix_dedup,
        op10_toxic_spans,
    )
}

ORACLE_SQL = {"op8_exact_dedup": exact_dedup.SQL}
