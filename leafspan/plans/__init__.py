"""leafspan.plans"""
