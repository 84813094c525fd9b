"""Spark jobs for candidate-ranking tables: staging, ontology graphs, retrieval, fusion, metrics, statistics and models."""
