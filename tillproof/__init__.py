"""tillproof: proved and exactly divided bills at data-set scale, on PySpark."""
