"""Vaccination and mortality register analytics on Spark DataFrames.

``functions`` holds column expressions, ``operators`` DataFrame-to-DataFrame
steps, ``sources`` readers, writers and literal dimensions, ``plans`` the
registered queries over the sample tables together with their SQL checks.
"""
