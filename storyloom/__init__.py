"""storyloom: timestamped documents and events to storylines, on Spark DataFrames."""
