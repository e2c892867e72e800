"""leafspan.streaming"""
