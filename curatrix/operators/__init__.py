"""Operators over tables of posts, cards, collections, settings and run logs: DataFrame in, DataFrame out."""
