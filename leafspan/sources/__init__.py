"""leafspan.sources"""
