"""leafspan.functions"""
