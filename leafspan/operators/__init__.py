"""leafspan.operators"""
