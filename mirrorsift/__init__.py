"""mirrorsift: duplicate and near-duplicate analytics as Spark DataFrame operators."""
