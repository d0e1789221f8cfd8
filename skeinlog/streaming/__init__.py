"""skeinlog.streaming"""
