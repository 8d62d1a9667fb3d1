"""photonest: photo-curation and corpus analytics expressed as Spark DataFrames."""
