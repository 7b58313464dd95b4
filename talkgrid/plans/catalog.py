"""All registries of the core."""

from talkgrid.plans import cue_queries, document_queries, interval_queries, review_queries, sequence_queries, small_queries, stream_queries, transcript_queries, vector_queries

REGISTRIES = [small_queries.REGISTRY, review_queries.REGISTRY, stream_queries.REGISTRY, cue_queries.REGISTRY, document_queries.REGISTRY, vector_queries.REGISTRY, sequence_queries.REGISTRY, interval_queries.REGISTRY, transcript_queries.REGISTRY]
