"""Genotype-to-phenotype analytics as Spark jobs."""
