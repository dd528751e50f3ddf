"""Package names: parts, nearest popular name and look-alikes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# Names that decide results.
POPULAR = (
    "react", "react-dom", "lodash", "express", "axios", "typescript", "webpack", "eslint", "prettier", "jest", "mocha", "chai", "babel", "commander",
    "chalk", "inquirer", "yargs", "dotenv", "bcrypt", "jsonwebtoken", "mongoose", "sequelize", "redis", "socket.io", "next", "vue", "angular",
    "prisma", "graphql", "apollo", "tailwind", "vite", "rollup", "esbuild",
    "moment", "dayjs", "date-fns", "uuid", "validator", "async", "request", "bluebird", "ramda", "underscore", "debug", "colors", "ora", "boxen",
    "helmet", "cors", "cookie-parser", "body-parser", "express-validator", "passport", "passport-jwt", "passport-local", "express-session",
    "cypress", "puppeteer", "playwright", "supertest", "sinon", "ava", "gulp", "grunt", "parcel", "browserify", "tsup", "unbuild",
    "nestjs", "fastify", "koa", "hapi", "nuxt", "gatsby", "remix", "mongodb", "mysql", "pg", "sqlite3", "knex", "typeorm",
    "react-router", "react-router-dom", "react-query", "react-redux", "react-hook-form", "react-icons", "react-select", "react-table",
    "react-dnd", "react-spring", "framer-motion", "styled-components", "zustand", "recoil", "jotai", "redux", "redux-toolkit", "mobx", "immer",
    "node-fetch", "got", "cross-fetch", "ky", "superagent", "needle", "undici", "node-axios",
    "bcryptjs", "argon2", "jose", "jwks-rsa", "node-rsa", "crypto-js", "speakeasy", "node-otp", "otplib",
    "aws-sdk", "firebase", "firebase-admin", "stripe", "twilio", "sendgrid", "@sendgrid/mail", "nodemailer", "mailchimp", "sendbird", "pusher", "@tanstack/react-query",
    "zod", "yup", "joi", "class-validator", "ajv", "superstruct", "io-ts", "drizzle-orm", "kysely", "mikro-orm", "objection",
    "turbo", "nx", "lerna", "changesets", "wireit", "rush",
    "lodash-es", "nanoid", "clsx", "classnames", "ms", "p-limit", "execa", "cross-env", "dotenv-expand", "env-cmd", "glob", "fast-glob", "micromatch", "minimatch",
    "semver", "node-semver", "compare-versions", "csv-parse", "papaparse", "xlsx", "exceljs", "sharp", "jimp", "canvas", "multer", "formidable", "busboy",
    "winston", "pino", "bunyan", "log4js", "morgan", "pm2", "nodemon", "concurrently", "js-yaml", "yaml", "toml", "ini", "compression", "ioredis", "kafkajs",
)
ATTACKS = (
    ("crossenv", "cross-env"), ("cross_env", "cross-env"), ("nodemailer-js", "nodemailer"), ("loadyaml", "js-yaml"), ("babbel", "babel"), ("mongose", "mongoose"), ("expres", "express"), ("expresss", "express"),
    ("lodas", "lodash"), ("lodash-js", "lodash"), ("recat", "react"), ("reeact", "react"), ("reactt", "react"), ("axois", "axios"), ("axio", "axios"), ("axxios", "axios"), ("webapck", "webpack"), ("webpackk", "webpack"),
    ("eslint-js", "eslint"), ("typscript", "typescript"), ("typescipt", "typescript"), ("mogoose", "mongoose"), ("chak", "chalk"), ("chalkjs", "chalk"), ("momment", "moment"), ("momnet", "moment"), ("uuidjs", "uuid"),
    ("socket-io", "socket.io"), ("socketio", "socket.io"), ("nextjs", "next"), ("vuejs", "vue"), ("angularjs", "angular"), ("pasport", "passport"), ("passportjs", "passport"), ("bcrypt-js", "bcryptjs"), ("prismajs", "prisma"),
    ("graphqll", "graphql"), ("fastifyjs", "fastify"), ("koajs", "koa"), ("nuxtjs", "nuxt"), ("gatbsy", "gatsby"), ("remmix", "remix"), ("node-mailer", "nodemailer"), ("lodashs", "lodash"), ("reactjs", "react"),
    ("webapack", "webpack"), ("coffescript", "coffeescript"), ("coffe-script", "coffeescript"), ("gruntcli", "grunt-cli"), ("gulp-cli", "gulp"), ("jquerry", "jquery"), ("jquery.js", "jquery"), ("tkinter", "tk"),
)
#: Characters that are taken for one another.
ALIKE = (("0", "o"), ("1", "l"), ("1", "i"), ("3", "e"), ("5", "s"), ("o", "0"), ("l", "1"), ("l", "i"), ("i", "1"), ("i", "l"), ("e", "3"), ("s", "5"))


def package_of(specifier: Column) -> Column:
    """The package of an import: with its scope, without a subpath; a runtime module (node:fs) is itself."""
    parts = F.split(specifier, "/")
    scoped = F.when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/"))
    return F.when(specifier.startswith("node:"), specifier).otherwise(F.coalesce(scoped, F.element_at(parts, 1)))


def nearest(name: Column, popular: Sequence[str]) -> Column:
    """struct(nearest, distance): the popular name at the smallest distance over 0; the first of the list on ties."""
    options = F.transform(F.array(*[F.lit(p) for p in popular]), lambda p, o: F.struct(F.levenshtein(name, p).alias("distance"), o.alias("o"), p.alias("nearest")))
    best = F.array_min(F.filter(options, lambda x: x["distance"] > 0))
    return F.struct(best["nearest"].alias("nearest"), best["distance"].alias("distance"))


def allowed_distance(name: Column, other: Column) -> Column:
    """How far a look-alike may be: a fifth of the shorter name, 1 to 2."""
    return F.greatest(F.lit(1), F.least(F.lit(2), F.floor(0.2 * F.least(F.length(name), F.length(other))).cast("int")))


def typosquat(name: Column, popular: Sequence[str] = POPULAR, attacks: Sequence[tuple[str, str]] = ATTACKS) -> Column:
    """struct(target, distance, confidence) of the package that a name passes itself off as, or null.

    Scoped and popular names are none. A known attack comes first, then a name that differs in `_` and `-` alone; else the
    nearest popular name, within the allowed distance, or one more where that is two.
    """
    low = F.lower(name)
    dashed = F.replace(low, F.lit("_"), F.lit("-"))
    verdict = lambda target, distance, sure: F.struct(target.alias("target"), distance.cast("int").alias("distance"), sure.alias("confidence"))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in attacks for x in pair]), low)
    separated = F.element_at(F.filter(F.array(*[F.lit(p) for p in popular]), lambda p: F.replace(F.lower(p), F.lit("_"), F.lit("-")) == dashed), 1)
    separated = F.when(F.array_contains(F.array(*[F.lit(p.lower().replace("_", "-")) for p in popular]), dashed), separated)
    best = nearest(low, popular)
    limit = allowed_distance(name, best["nearest"])
    near = (best["distance"] <= limit) | ((limit >= 2) & (best["distance"] == limit + 1))
    none = name.startswith("@") | low.isin(*[p.lower() for p in popular])
    return (
        F.when(none, None)
        .when(known.isNotNull(), verdict(known, F.lit(1), F.lit("high")))
        .when(separated.isNotNull(), verdict(separated, F.lit(1), F.lit("high")))
        .when(near, verdict(best["nearest"], best["distance"], F.when(best["distance"] == 1, "high").otherwise("medium")))
    )


def squat_shape(name: Column, target: Column) -> Column:
    """Whether a name has the shape of a slip in a target: other separators, a letter less or more at an end, two neighbours
    swapped, or a letter that looks alike."""
    a, b = F.lower(name), F.lower(target)
    places = F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1)))
    part = lambda at, size: F.substr(b, at, size)
    rest = lambda at: F.substr(b, at, F.greatest(F.length(b) - at + 1, F.lit(0)))
    one = F.lit(1)
    swapped = F.exists(places, lambda i: (i < F.length(b)) & (F.concat(part(one, i - 1), part(i + 1, one), part(i, one), rest(i + 2)) == a))
    alike = F.exists(places, lambda i: reduce(lambda x, y: x | y, [(part(i, one) == was) & (F.concat(part(one, i - 1), F.lit(now), rest(i + 1)) == a) for was, now in ALIKE]))
    separators = (F.replace(a, F.lit("_"), F.lit("-")) == b) | (F.replace(a, F.lit("-"), F.lit("_")) == b)
    return separators | ((F.length(a) == F.length(b) - 1) & b.contains(a)) | ((F.length(a) == F.length(b) + 1) & a.contains(b)) | swapped | alike
